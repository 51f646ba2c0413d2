"""Markup as elements, by one pass over a page's tags: as lists in columns, or for functions that read whole batches of pages.

An element is an interval of tags: ``at`` is the place of its start tag, ``end`` that of the tag
that closes it, both counted from 1, so that an element lies in another exactly if its interval does.  The texts
between tags are kept beside them: ``gaps[i]`` follows tag i, and ``gaps[0]`` precedes the first.
"""

from __future__ import annotations

import functools
import html.entities
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etalage import vocab

# What counts as a tag.  Groups repeat possessively, which the matcher does in a
# loop, and a tag or quote that never ends takes the rest of the page, so every page is read once.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style)\b[^>]*+>.*?(?:</\1[^>]*+>|\z))"
TAG = r"""(?s)<[!?][^>]*+(?:>|\z)|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|["'].*\z|\z)"""
TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
NAME_AND_VALUE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?"""
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
#: Elements that hold nothing and are closed by their start tag.
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "keygen", "menuitem", "nextid", "spacer",
)


@dataclass(frozen=True)
class Test:
    """Marks elements of a name ('' for any) with all of some classes and none of others.

    ``within`` is the place of the test that one of its ancestors has to pass.
    """

    name: str = ""
    classes: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    within: int | None = None

    __test__ = False  # not one of pytest's


def unescape(text: Column) -> Column:
    """Character references of closed form (``&eacute;``, ``&#233;``, ``&#xe9;``) as characters."""
    named = F.str_to_map(
        F.lit("\x02".join(f"{n}\x01{chr(c)}" for n, c in [*html.entities.name2codepoint.items(), ("apos", 39)])),
        F.lit("\x02"),
        F.lit("\x01"),
    )

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.regexp_extract(name, "^#[xX]?(.*)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = F.when(name.startswith("#"), F.when(valid, char).otherwise(F.lit("�"))).otherwise(F.try_element_at(named, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when((name == "") | known.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(known, rest))

    pieces = F.split(text, "&")
    joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    return F.when(text.contains("&"), joined).otherwise(text)


def _pieces(gaps: Column, element: Column) -> Column:
    return F.slice(gaps, element["at"] + 1, F.greatest(element["end"] - element["at"], F.lit(0)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, vocab.EDGE_WHITESPACE, "")


def stripped_text_of(gaps: Column, element: Column, between: str = "") -> Column:
    """The stripped texts within an element, joined; blank ones are left out."""
    texts = F.transform(_pieces(gaps, element), lambda t: stripped(unescape(t)))
    return F.array_join(F.filter(texts, lambda t: t != ""), between)


_ELEMENTS = (
    "array<struct<at:int,end:int,parent:int,depth:int,up:array<int>,name:string,close:boolean,cls:string,raw:string>>"
)


def text_tools() -> tuple[Callable[..., str], Callable[..., str | None]]:
    """Functions on one text, for tasks that run without this package: ``unescape``, and the value of a tag's attribute."""
    known = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}
    # \s is ASCII's, as in the patterns of the columns
    pairs, reference = re.compile(NAME_AND_VALUE, re.ASCII).findall, re.compile(REFERENCE, re.ASCII)

    def unescaped(text: str, mark: str = "") -> str:
        """With ``mark`` for a byte order mark, which the decoder of the columns takes away."""
        if "&" not in text:
            return text
        first, *pieces = text.split("&")
        done = [first]
        for piece in pieces:
            found = reference.match(piece)
            name, char = found[1] if found else "", None
            if name.startswith("#"):
                code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
                char = chr(code) if 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF else "\ufffd"
                char = mark if char == "\ufeff" else char
            elif name:
                char = known.get(name)
            done.append("&" + piece if char is None else char + piece[len(name) + 1 :])
        return "".join(done)

    def attribute_of(raw: str, name: str, mark: str = "") -> str | None:
        """An attribute's decoded value; None if the tag does not have it, the last if it is repeated."""
        if name not in raw.lower():
            return None
        mine = [value for own, value in pairs(raw) if own.lower() == name]
        if not mine:
            return None
        text = mine[-1]
        if len(text) > 1 and text[0] in "\"'" and text[-1] == text[0]:
            text = text[1:-1]
        return unescaped(text, mark)

    return unescaped, attribute_of


def _tag_reader(tests: Sequence[Test], facts: Callable[[str, str, str], object] | None = None) -> tuple[Callable, Callable]:
    """What a tag is by itself, and the intervals of a page's tags, by one pass over them whatever their depth.

    A close tag closes the innermost open element of its name and all that is open within it; one
    without such an element is stray.  What is open at the end closes there.  An element inherits
    from its parent the nearest ancestors that pass each test.
    Both functions hold all they need, so that tasks run them without this package.
    """
    marks = [(j, frozenset(t.classes), frozenset(t.without), t.within, t.name) for j, t in enumerate(tests)]
    of_any = [m[:4] for m in marks if not m[4]]
    of_name = {t.name: [m[:4] for m in marks if m[4] in ("", t.name)] for t in tests if t.name}
    zeros, void_names = (0,) * len(marks), {"", *VOID}
    tag_name, spaces = re.compile(TAG_NAME, re.ASCII), re.compile(r"\s+", re.ASCII)
    _, attribute_of = text_tools()

    def parsed(raw: str) -> tuple:
        """Name, is it a close tag, is it closed by itself, classes, the tests that these pass, and a start tag's further facts."""
        found = tag_name.match(raw)
        name, closes = found[1].lower() if found else "", raw.startswith("</")
        own = attribute_of(raw, "class", "\ufeff")
        classes = f" {spaces.sub(' ', own)} " if own else "  "
        words = {*classes.split(" ")}
        passed = [(j, within) for j, having, without, within in of_name.get(name, of_any) if having <= words and without.isdisjoint(words)]
        return name, closes, name in void_names or raw.endswith("/>"), classes, passed, None if closes or facts is None else facts(name, classes, raw)

    def intervals(tags: Sequence[tuple]) -> tuple[list[int], list[tuple[int, ...]]]:
        """End and marked ancestors of each tag of one page."""
        ends, ups = [len(tags) + 1] * len(tags), [zeros] * len(tags)
        opened: list[tuple[int, str, tuple[int, ...]]] = []  # with the marks around each
        held: dict[str, int] = {}  # how many elements of each name are open
        down = zeros
        for k, (name, closes, void, _, passed, _) in enumerate(tags):
            if closes:
                if not held.get(name):
                    ends[k] = -1
                    continue
                ends[k] = 0
                inner = None
                while inner != name:
                    at, inner, down = opened.pop()
                    ends[at] = k + 1
                    held[inner] -= 1
                continue
            ups[k] = down
            if void:
                ends[k] = k + 1
                continue
            opened.append((k, name, down))
            held[name] = held.get(name, 0) + 1
            if passed:
                up = down
                for j, within in passed:
                    if within is None or up[within] > 0:
                        down = (*down[:j], k + 1, *down[j + 1 :])
        return ends, ups

    return parsed, intervals


def page_reader(tests: Sequence[Test], facts: Callable[[str, str, str], object]) -> Callable[[pa.Array], Iterator[tuple]]:
    """A function from a batch of pages to the texts between tags, tags, ends and marked ancestors of each.

    A tag is its name, is it a close tag, is it closed by itself, its classes, the tests that these pass, and its
    facts (of a start tag's name, classes and markup).  A batch's different tags are parsed once.
    """
    parsed, intervals = _tag_reader(tests, facts)
    cut = re.compile(f"({TAG})".replace("(?s)", "").replace(r"\z", r"\Z"), re.DOTALL).split

    def read(pages: pa.Array) -> Iterator[tuple]:
        known = functools.cache(parsed)
        for page in pages.cast(pa.large_binary()):
            parts = cut(page.as_py().decode("utf-8", "replace"))
            tags = [*map(known, parts[1::2])]
            yield parts[::2], tags, *intervals(tags)

    return read


def _elements(tests: Sequence[Test]) -> Callable[[Column], Column]:
    """The tags of each page as elements; a batch's different tags are parsed once."""
    parsed, intervals = _tag_reader(tests)
    width = len(tests)

    def placed(tags: Sequence[tuple], ends: Sequence[int]) -> tuple[list[int], list[int]]:
        """Parent and depth of each tag; a close tag is as deep as what is open before it."""
        parents, depths, opened = [0] * len(tags), [0] * len(tags), []
        for k, (_, closes, void, *_) in enumerate(tags, 1):
            while opened and ends[opened[-1] - 1] < k:
                opened.pop()
            depths[k - 1] = len(opened)
            if not closes:
                parents[k - 1] = opened[-1] if opened else 0
                if not void:
                    opened.append(k)
        return parents, depths

    @F.arrow_udf(returnType=_ELEMENTS)
    def fold(pages: pa.Array) -> pa.Array:
        offsets = pages.offsets.to_pylist()
        start = offsets[0]
        raw = pages.values.slice(start, offsets[-1] - start)
        coded = raw.dictionary_encode()
        different = [parsed(x) for x in coded.dictionary.to_pylist()]
        tags = [different[x] for x in coded.indices.to_pylist()]
        at, found, inner = array("i"), [array("i") for _ in range(3)], array("i")
        for first, last in zip(offsets, offsets[1:]):
            at.extend(range(1, last - first + 1))
            own = tags[first - start : last - start]
            ends, ups = intervals(own)
            for whole, part in zip(found, (ends, *placed(own, ends))):
                whole.extend(part)
            for up in ups:
                inner.extend(up)
        places = pa.array(range(0, width * len(at) + 1, width) if width else [0] * (len(at) + 1), pa.int32())
        up, *numbers = (pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (inner, at, *found))
        up = pa.ListArray.from_arrays(places, up)
        own = [pa.array([t[k] for t in different], kind).take(coded.indices) for k, kind in ((0, pa.string()), (1, pa.bool_()), (3, pa.string()))]
        elements = pa.StructArray.from_arrays(
            [*numbers, up, *own, raw], ["at", "end", "parent", "depth", "up", "name", "close", "cls", "raw"]
        )
        return pa.ListArray.from_arrays(pa.array([x - start for x in offsets], pa.int32()), elements)

    return fold


def shown(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with what counts as markup in ``_shown``: comments, scripts and styles are a tag without a name."""
    session = pages.sparkSession
    if session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default, which is many pages at once
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    keys = [c for c in pages.columns if c != html]
    markup = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, "<!>")
    return pages.select(*keys, F.explode(F.array(markup)).alias("_shown"))


def element_lists(pages: DataFrame, tests: Sequence[Test] = (), html: str = "html", gaps: str = "_gaps", elements: str = "_elements") -> DataFrame:
    """The pages with their texts between tags and, per tag, its element in place of the markup.

    ``elements[i - 1]`` belongs to tag i; those of close tags have ``close`` set, and an ``end`` of -1 if they
    are stray.  ``up[j]`` is the place of the nearest ancestor that passes test j, or 0.  Comments, scripts
    and styles are elements without a name and without text.  A null page has no tags.
    Each step leaves through a one-row generator, so that the optimizer does not repeat it.
    """
    keys = [c for c in pages.columns if c != html]
    return (
        shown(pages, html)
        .select(*keys, F.explode(F.array(F.struct(F.regexp_extract_all("_shown", F.lit(TAG), F.lit(0)).alias("raw"), F.split("_shown", TAG, -1).alias("gaps")))).alias("_cut"))
        .select(*keys, F.col("_cut.gaps").alias(gaps), F.explode(F.array(_elements(tests)(F.col("_cut.raw")))).alias(elements))
    )


def element_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per element: its interval, parent, depth, name and own text, beside the page's other columns."""
    keys = [c for c in pages.columns if c != html]
    listed = F.transform(
        F.filter("_elements", lambda e: ~e["close"] & (e["name"] != "")),
        lambda e: F.struct(
            e["at"].alias("at"), e["end"].alias("end"), e["parent"].alias("parent"), e["depth"].alias("depth"),
            e["name"].alias("name"), F.trim(e["cls"]).alias("classes"), F.length(stripped_text_of(F.col("_gaps"), e)).alias("n_chars"),
        ),
    )
    return element_lists(pages, html=html).select(*keys, F.explode(listed).alias("_e")).select(*keys, "_e.*")
