"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each has
the tags and class words of its ancestors and some traits of its text as features; a
two-state chain, trained on labelled pages, says which blocks are main text.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage.llm.common import mix, small_batches

#: Pages that labelled training pages are made from, at most (in the order of a hash of the id).
MAX_TRAIN = 300
#: Hashed features.
WIDTH = 1 << 14
ROUNDS = 80

#: Fixed values of the page language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("script style noscript template head iframe object svg math canvas audio video select textarea title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: What labels the blocks of a page whose markup is outspoken.
MAIN_TAGS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset("nav header footer aside form button fieldset menu dialog".split())
ASIDE_WORDS = frozenset((
    "ad ads advert advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related "
    "recommended share social comment comments reply replies disqus notice cookie cookies consent popup modal newsletter subscribe login search copyright legal tags pagination pager"
).split())
MAIN_WORDS = frozenset("article content main post entry story body text page maincontent articlebody".split())

_OPENED = re.compile(r"<!?/?[a-zA-Z][^\s>/]*")
_SIGN = re.compile("[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    tags: tuple[str, ...]  # ancestors, outermost first
    words: tuple[str, ...]  # of the ancestors' class, id, role and itemprop
    nearest: str = ""  # what the innermost telling ancestor is: main, aside or nothing


def nearest(frames: list[tuple[str, tuple[str, ...]]]) -> str:
    """Whether the innermost ancestor that tells by its tag or words is main text or not."""
    for place in range(len(frames) - 1, -1, -1):
        tag, words = frames[place]
        if tag == "header" and any(t in MAIN_TAGS for t, _ in frames[:place]):
            return "main"
        if tag in ASIDE_TAGS or any(w in ASIDE_WORDS for w in words):
            return "aside"
        if tag in MAIN_TAGS or any(w in MAIN_WORDS for w in words):
            return "main"
    return ""


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of ``>`` and quotes, and for each where a tag read from there ends, -1 for nowhere.

    One pass from the right, so a page of tags that never end takes no more time than another.
    """
    signs = [found.start() for found in _SIGN.finditer(page)]
    ends = [-1] * (len(signs) + 1)
    closing = {'"': len(signs), "'": len(signs)}
    for k in range(len(signs) - 1, -1, -1):
        sign = page[signs[k]]
        if sign == ">":
            ends[k] = signs[k] + 1
        else:
            ends[k] = ends[min(closing[sign] + 1, len(signs))]
            closing[sign] = k
    return signs, ends


def _texts(page: str) -> Iterator[tuple[str, str]]:
    """(tag, text) tokens; a sign that opens no tag is text."""
    signs, ends = _tag_ends(page)
    last_end, last_start = page.rfind(">"), page.rfind("<")
    place = 0
    while place < len(page):
        start = page.find("<", place)
        if start < 0:
            yield "", page[place:]
            return
        if start > place:
            yield "", page[place:start]
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            if close < 0:
                return
            place = close + 3
            continue
        opened = _OPENED.match(page, start)
        place = ends[bisect_left(signs, opened.end())] if opened else -1
        if place < 0 and start < last_end and page[start + 1] in "!?":
            place = page.index(">", start) + 1
        if place < 0 and opened and start == last_start and start > last_end and page[start + 1] != "!":
            place = len(page)  # cut off in its last tag
        if place < 0:
            place = start + 1
            yield "", "<"
            continue
        token = page[start:place]
        name = _NAME.match(token)
        yield token, ""
        if name and token[1] != "/" and (raw := name[1].lower()) in RAW:
            close = re.compile(rf"</{re.escape(raw)}\b", re.IGNORECASE).search(page, place)
            place = close.start() if close else len(page)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            value = _BLANK.sub(" ", markup.unescape("".join(text))).strip()
            if value:
                tags = tuple(t for t, _ in stack)
                words = tuple(dict.fromkeys(w for _, own in stack for w in own))
                found.append(Block(value, linked, tags, words, nearest(stack)))
            text.clear()
        linked = 0

    hidden = 0
    for token, value in _texts(page):
        if not token:
            if not hidden:
                text.append(value)
                if any(t == "a" for t, _ in stack):
                    linked += len(value.strip())
            continue
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag not in INLINE:
                flush()
            if any(t == tag for t, _ in stack):
                while stack:
                    last, _ = stack.pop()
                    hidden -= last in UNSEEN
                    if last == tag:
                        break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            for place in range(len(stack) - 1, -1, -1):
                last = stack[place][0]
                if tag in CLOSED_BY.get(last, ()):
                    del stack[place:]
                    break
                if last not in INLINE and last not in CLOSED_BY:
                    break
        if tag in VOID or token.endswith("/>"):
            continue
        words = tuple(w.lower() for m in _ATTRIBUTE.finditer(token) for w in _PARTS.findall(m[2])) if "=" in token else ()
        stack.append((tag, words))
        hidden += tag in UNSEEN
    flush()
    return found


def outspoken(block: Block) -> int | None:
    """1 main text, 0 not, by explicit markup alone; None if that says nothing."""
    if ASIDE_TAGS & {t for k, t in enumerate(block.tags) if t != "header" or "article" not in block.tags[:k]} or not ASIDE_WORDS.isdisjoint(block.words):
        return 0
    return 1 if MAIN_TAGS & set(block.tags) else None


def _bucket(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def _traits(page: list[Block]) -> list[list[str]]:
    """The features of each block, as strings."""
    rows = []
    for place, block in enumerate(page):
        length = len(block.text)
        words = block.text.count(" ") + 1
        stops = sum(block.text.count(c) for c in ".!?…。")
        row = [f"t:{t}" for t in set(block.tags)]
        row += [f"w:{w}" for w in block.words]
        row.append("p:" + "/".join([t for t in block.tags if t not in INLINE][-2:]))
        row += [f"near:{block.nearest}", f"aside:{not ASIDE_WORDS.isdisjoint(block.words)}", f"main:{not MAIN_WORDS.isdisjoint(block.words)}"]
        row += [f"n:{_bucket(words, (2, 4, 8, 15, 30, 60, 120))}", f"l:{_bucket(block.linked / max(length, 1), (0.01, 0.2, 0.5, 0.9))}"]
        row += [f"s:{_bucket(stops / words, (0.01, 0.05, 0.15, 0.4))}", f"e:{block.text[-1] in '.!?…'}", f"at:{_bucket(place / len(page), (0.1, 0.3, 0.7, 0.9))}"]
        if "©" in block.text:
            row.append("sign:copyright")
        if place == 0 or place == len(page) - 1:
            row.append(f"edge:{place == 0}")
        rows.append(row)
    return rows


class Chain(NamedTuple):
    weights: np.ndarray  # feature by state
    steps: np.ndarray  # from state to state


def _places(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all blocks in one array, and where each block's begin."""
    sizes = np.array([len(r) for r in rows])
    flat = np.array([hash_word(w) for r in rows for w in r], np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])


_hashes: dict[str, int] = {}


def hash_word(word: str) -> int:
    """A stable place of a feature (Python's own hash differs between workers)."""
    found = _hashes.get(word)
    if found is None:
        if len(_hashes) > 100_000:
            _hashes.clear()
        value = int.from_bytes(word.encode("utf-8", "replace").ljust(8, b"\0"), "little") % (2**64 - 59)
        found = _hashes[word] = int(mix(np.array([value], np.uint64))[0] % np.uint64(WIDTH))
    return found


def decode(chain: Chain, page: list[Block]) -> list[int]:
    """The most probable states of a page's blocks (Viterbi)."""
    flat, begin = _places(_traits(page))
    own = np.add.reduceat(chain.weights[flat], begin, axis=0)
    best, back = own[0], np.zeros((len(page), 2), np.int64)
    for k in range(1, len(page)):
        ways = best[:, None] + chain.steps
        back[k] = ways.argmax(axis=0)
        best = ways.max(axis=0) + own[k]
    states = [int(best.argmax())]
    for k in range(len(page) - 1, 0, -1):
        states.append(int(back[k][states[-1]]))
    return states[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS) -> Chain:
    """Maximum penalised likelihood by full-batch gradient steps (forward and backward sums)."""
    weights, steps = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    pages = [p for p in pages if p[0]]
    if not pages:
        weights[hash_word("near:main")] = [0.0, 1.0]
        return Chain(weights, steps)
    size = np.array([len(b) for b, _ in pages])
    flat, begin = _places([row for page, _ in pages for row in _traits(page)])
    block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(flat))))
    states = np.concatenate([s for _, s in pages]).astype(np.int64)
    longest = int(size.max())
    row = np.repeat(np.arange(len(pages)), size)
    column = np.arange(len(states)) - np.repeat(np.cumsum(size) - size, size)
    real = np.zeros((len(pages), longest), bool)
    real[row, column] = True
    target = np.zeros((len(states), 2))
    target[np.arange(len(states)), states] = 1
    inner = column[1:] > 0
    moves = np.zeros((2, 2))
    np.add.at(moves, (states[:-1][inner], states[1:][inner]), 1)
    scale, scale_steps = np.full_like(weights, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        own = np.zeros((len(pages), longest, 2))
        own[row, column] = np.add.reduceat(weights[flat], begin, axis=0)
        ahead, behind = own.copy(), np.zeros_like(own)
        for k in range(1, longest):
            way = np.logaddexp(ahead[:, k - 1, :1] + steps[0], ahead[:, k - 1, 1:] + steps[1]) + own[:, k]
            ahead[:, k] = np.where(real[:, k, None], way, ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        expected = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            after = own[:, k + 1] + behind[:, k + 1]
            way = np.logaddexp(steps[:, 0] + after[:, :1], steps[:, 1] + after[:, 1:])
            both = np.exp(ahead[:, k, :, None] + steps + after[:, None, :] - total[:, None, None])
            expected += both[real[:, k + 1]].sum(axis=0)
            behind[:, k] = np.where(real[:, k + 1, None], way, 0.0)
        chance = np.exp(ahead + behind - total[:, None, None])[row, column]
        off = (target - chance)[block]
        slope = np.stack([np.bincount(flat, off[:, s], WIDTH) for s in (0, 1)], axis=1)
        slope -= 0.1 * weights
        scale += slope**2
        weights += 0.5 * slope / np.sqrt(scale)
        slope = moves - expected - 0.1 * steps
        scale_steps += slope**2
        steps = steps + 0.5 * slope / np.sqrt(scale_steps)
    return Chain(weights, steps)


#: Layouts a labelled page is set in anew: (ancestors of main text, of other blocks by place).
_MAIN_FRAMES = (
    (("main", ()), ("div", ("content",))), (("div", ("main", "content")),), (("div", ("post", "body")), ("div", ("text",))), (("section", ("story",)),), (("div", ("entry",)),),
    (("article", ()),), (("article", ("post",)), ("section", ())), (("div", ()), ("div", ())), (("table", ()), ("tr", ()), ("td", ())), (("div", ("article",)),),
)
_HEAD_FRAMES = ((("header", ()),), (("div", ("header",)),), (("nav", ()), ("ul", ()), ("li", ())), (("div", ("menu",)), ("ul", ()), ("li", ())), (("div", ("cookie", "notice")),), (("div", ("breadcrumb",)),), (("div", ("ad",)),), (("form", ("search",)),), (("div", ("banner",)),))
_FOOT_FRAMES = ((("footer", ()),), (("div", ("footer",)),), (("aside", ()), ("div", ("sidebar",))), (("div", ("sidebar",)), ("ul", ()), ("li", ())), (("section", ("comments",)), ("div", ("comment",))), (("div", ("comments",)), ("ul", ()), ("li", ("reply",))), (("div", ("related",)), ("ul", ()), ("li", ())), (("form", ("newsletter",)),), (("div", ("advertisement",)),), (("div", ("share", "social")),))
_INSIDE_FRAMES = ((("aside", ()),), (("div", ("ad",)),), (("div", ("related",)),), (("div", ("newsletter",)), ("form", ())), (("div", ("share",)),), (("div", ("comments",)),), (("figure", ("advert",)),), (("nav", ("tags",)),))


def labelled_pages(pages: list[list[Block]], seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages whose blocks are all labelled by outspoken markup, and the same texts in other layouts.

    In a new layout the labels stay while ancestors and class words change, so the
    chain learns from texts and many kinds of frames, not from one site's tags.
    """
    chance = np.random.RandomState(seed)
    known = [(page, [outspoken(b) for b in page]) for page in pages]
    known = [(page, labels) for page, labels in known if page and None not in labels and 1 in labels]
    others = [b for page, labels in known for b, s in zip(page, labels, strict=True) if not s] or [Block("Menu", 4, (), ())]
    texts = [b for page, labels in known for b, s in zip(page, labels, strict=True) if s]
    made = list(known)

    def framed(block: Block, frame, tag: str | None = None, outer=()) -> Block:
        tags = ("html", "body", *(t for t, _ in outer), *(t for t, _ in frame), *((tag,) if tag else ()))
        frames = [*outer, *frame]
        return Block(block.text, block.linked, tags, tuple(w for _, words in frames for w in words), nearest(frames))

    def pick(many):
        return many[chance.randint(len(many))]

    for page, labels in known:
        for _ in range(2):
            main = pick(_MAIN_FRAMES)
            rows: list[tuple[Block, int]] = []
            for frame in [pick(_HEAD_FRAMES) for _ in range(chance.randint(1, 4))]:
                rows += [(framed(pick(others), frame), 0) for _ in range(chance.randint(1, 6))]
            own = [b for b, s in zip(page, labels, strict=True) if s]
            for k, block in enumerate(own):
                tag = "h1" if k == 0 and "h1" in block.tags else pick(("p", "p", "p", "p", "blockquote", "li", "h2", "pre", "div"))
                rows.append((framed(block, main, tag), 1))
                if chance.rand() < 0.1 and k:
                    rows.append((framed(pick(others), pick(_INSIDE_FRAMES), None, main), 0))
            for frame in [pick(_FOOT_FRAMES) for _ in range(chance.randint(1, 4))]:
                source = texts if any("comment" in w for _, words in frame for w in words) else others
                rows += [(framed(pick(source), frame, pick((None, "p"))), 0) for _ in range(chance.randint(1, 5))]
            made.append(([b for b, _ in rows], [s for _, s in rows]))
    return made


def fit(pages: DataFrame, max_train: int = MAX_TRAIN) -> Chain:
    """A chain fitted on at most ``max_train`` pages, chosen by a hash of the id."""
    some = pages.where("html is not null").select("html", F.xxhash64(F.col("page_id").cast("long"), F.substring("html", 1, 1000)).alias("h"))
    # only hashes are ordered, so tasks do not each send their own candidates' pages
    last = some.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    rows = some.where(F.col("h") <= F.lit(last)).limit(max_train).select("html").collect()
    return train(labelled_pages([blocks(r.html) for r in rows]))


def extract_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_blocks.

    The whole page is read; blocks the chain takes for main text are joined by two
    line feeds.  White space inside a block is one blank, character references are
    decoded.  A null or empty page, or one without main text, has the text '' and
    n_chars 0; null ids and urls and repeated rows stay as they are; other columns
    are ignored; an empty table gives no rows.  Markup that ends too early is read
    up to its end.
    """
    small_batches(pages.sparkSession)
    chain = chain or fit(pages)
    shared = pages.sparkSession.sparkContext.broadcast(chain)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def rows(batches):
        chain = shared.value
        for batch in batches:
            texts, counts = [], []
            for page in batch.column("html"):
                found = blocks(page.as_py() or "")
                kept = [b.text for b, s in zip(found, decode(chain, found), strict=True) if s] if found else []
                texts.append("\n\n".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    fields = [("page_id", T.LongType()), ("url", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()), ("n_blocks", T.LongType())]
    return pages.mapInArrow(rows, T.StructType([T.StructField(*f) for f in fields]))
