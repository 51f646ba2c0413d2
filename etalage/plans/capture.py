"""Listing capture as table jobs over pages that have already been fetched.

Pages: ``category, page_no, magasin, url, html``.  Listings: one row per card with
``category, page_no, pos, name, href, price_text`` and the page's ``served_page`` and
``has_next``; a page without cards is one row with a null ``pos``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalage import vocab
from etalage.functions import text as tx
from etalage.functions.markup import Test, page_reader, shown, text_tools
from etalage.functions.numbers import ratio

# The markup the shops use.  Repeats run over single characters only,
# never over groups, so a page of any length stays within the matcher's stack.
TAG = r"(?s)<[^>]*>"
ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&amp;", "&"),
)
UNIT_PRICE_MARKS = ("/ L", "/ KG", "/ PIECE")
#: A price is looked for in so many siblings after a heading, texts included.
SIBLINGS = 25

OVERLAP_LIMIT = 0.8


def plain_text(markup: Column) -> Column:
    """Text of a piece of markup: tags dropped, entities decoded, spaces collapsed."""
    out = F.regexp_replace(markup, TAG, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return tx.collapse_spaces(out)


def page_links(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Every link of a page in document order: position, text, target."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))
    return pages.select(*keys, F.posexplode(anchors).alias("_pos", "_a")).select(
        *keys,
        (F.col("_pos") + 1).cast("bigint").alias("pos"),
        plain_text(F.regexp_extract("_a", ANCHOR, 2)).alias("name"),
        F.trim(F.regexp_extract("_a", ANCHOR, 1)).alias("href"),
    )


def _tagged(name: str, *classes: str) -> Test:
    """Elements of a name ('' for any) with all the classes."""
    return Test(name, classes)


def _within(test: Test, place: int) -> Test:
    """Elements that pass a test below one that passes the test of that place."""
    return replace(test, within=place)


def _enabled(test: Test) -> Test:
    return replace(test, without=("disabled",))


_MINIATURES = (_tagged("article", "product-miniature"), _tagged("", "product-miniature"), _tagged("", "js-product-miniature"))
#: Product cards of three kinds, headings in each kind, and any heading.
CARD_TESTS: tuple[Test, ...] = (*_MINIATURES, *(_within(_tagged("h2"), k) for k in range(3)), _tagged("h2"))
HEADING = 6


#: Of a tag (see ``page_reader``): is it a close tag, the tests that it passes, its facts.
CLOSES, PASSED, FACTS = 1, 4, 5
STRIDE = 6


def _said(unescaped: Callable[[str], str]) -> tuple[Callable[..., str], Callable[..., str]]:
    """All text from a tag to another with its spaces collapsed, and the stripped texts there that are not blank, joined."""

    def whole(gaps: Sequence[str], at: int, end: int) -> str:
        return " ".join(unescaped("".join(gaps[at:end])).split())

    def joined(gaps: Sequence[str], at: int, end: int, between: str = "") -> str:
        return between.join([t for t in [unescaped(g).strip() for g in gaps[at:end]] if t])

    return whole, joined


def _price_reader(reach: int) -> Callable[[int, Sequence[str], Sequence[tuple], Sequence[int], bool], str | None]:
    """First text among a heading's next siblings that states a price of the product itself."""
    unescaped, _ = text_tools()
    _, joined = _said(unescaped)
    # a text and a tag at a time; stray tags count as no sibling
    steps, per_unit = STRIDE * (3 * reach // STRIDE + 1) // 2, UNIT_PRICE_MARKS

    def states_price(text: str, in_francs: bool) -> bool:
        upper = text.upper()
        return "FCFA" in upper if in_francs else "CFA" in upper and not any(mark in upper for mark in per_unit)

    def price_after(at: int, gaps: Sequence[str], tags: Sequence[tuple], ends: Sequence[int], in_francs: bool) -> str | None:
        left = reach
        for _ in range(steps):
            if left <= 0 or at > len(tags):
                return None
            if text := gaps[at]:
                left -= 1
                if (text := unescaped(text).strip()) and states_price(text, in_francs):
                    return text
            if left <= 0 or at == len(tags):
                return None
            if tags[at][CLOSES]:
                if ends[at] == 0:
                    return None
                at += 1
                continue
            left -= 1
            text, at = joined(gaps, at + 1, ends[at]), ends[at]
            if text and states_price(text, in_francs):
                return text
        return None

    return price_after


def _link_facts() -> Callable[[str, str, str], str | None]:
    """Where a link leads, None of other elements."""
    _, attribute_of = text_tools()
    return lambda name, classes, raw: (attribute_of(raw, "href") or "").strip(" ") if name == "a" else None


def _card_reader(siblings: int) -> Callable[[Column, Column], Column]:
    """The cards of each page of markup; a shop whose prices are all in FCFA says so by the second column."""
    pages_of = page_reader(CARD_TESTS, _link_facts())
    whole, _ = _said(text_tools()[0])
    price_after, kinds, heading = _price_reader(siblings), range(3, HEADING + 1), HEADING
    facts_at = FACTS

    @F.arrow_udf(returnType="array<struct<name:string,href:string,price_text:string>>")
    def cards(html: pa.Array, in_francs: pa.Array) -> pa.Array:
        offsets, names, targets, prices = [0], [], [], []
        for (gaps, tags, ends, ups), francs in zip(pages_of(html), in_francs.to_pylist()):
            linked = [k for k, tag in enumerate(tags) if tag[facts_at] is not None and ups[k][heading] > 0]
            for kind in kinds:
                links = [k for k in linked if ups[k][kind] > 0]
                if links:
                    break
            priced: dict[int, str | None] = {}
            for k in links if linked else ():
                of = ups[k][heading]
                if of not in priced:
                    priced[of] = price_after(ends[of - 1], gaps, tags, ends, francs)
                names.append(whole(gaps, k + 1, ends[k]))
                targets.append(tags[k][facts_at])
                prices.append(priced[of])
            offsets.append(len(names))
        found = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (names, targets, prices)], ["name", "href", "price_text"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return cards


def extract_cards(pages: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """Links of product headings in document order, one row each; a page without any is one row.

    Headings inside article cards, else inside other product cards, else, on a page without any, all
    linked headings.  Every link of a heading is a card.  The price is the first that the heading's
    following ``siblings`` state, so a card's end is where its heading's parent ends.
    """
    in_francs = F.coalesce(F.col("magasin") == "Sakanal", F.lit(False))
    return _one_row_each(pages, _card_reader(siblings)(F.col("_shown"), in_francs))


def _one_row_each(pages: DataFrame, cards: Column) -> DataFrame:
    """Cards read from ``_shown`` with their places from 1; a page without any is one row."""
    keys = [c for c in pages.columns if c != "html"]
    return (
        shown(pages)
        .select(*keys, cards.alias("_cartes"))
        .select(*keys, F.posexplode_outer("_cartes").alias("_pos", "_carte"))
        .select(*keys, (F.col("_pos") + 1).cast("bigint").alias("pos"), "_carte.*")
    )


#: What the name of a tile may lie in.
TILE_TESTS: tuple[Test, ...] = (_tagged("h2"), _tagged("h3"), _tagged("", "thumbnail-top"))


def _tile_facts() -> Callable[[str, str, str], tuple | None]:
    """Of an element: is it a tile, may it be named there (if in a named place), is it a price, a link, an image; None if nothing."""
    _, attribute_of = text_tools()

    def facts(name: str, classes: str, raw: str) -> tuple | None:
        is_link, words = name == "a", {*classes.split(" ")}
        said = (
            (name == "article" and "product-miniature" in words) or "product-item" in words or "js-product-miniature" in words,
            name == "h3" or "product-name" in words or "product-title" in words or (is_link and "product-thumbnail" in words),
            is_link,
            "price" in words or "product-price" in words,
            is_link and attribute_of(raw, "href") is not None,
            name == "img" and (attribute_of(raw, "alt") is not None or attribute_of(raw, "title") is not None),
        )
        return (*said, raw) if any(said) else None

    return facts


def _tile_reader() -> Callable[[Column], Column]:
    pages_of = page_reader(TILE_TESTS, _tile_facts())
    unescaped, attribute_of = text_tools()
    whole, _ = _said(unescaped)
    facts_at = FACTS

    def first(places: Sequence[int], after: int, end: int) -> int:
        """The first of sorted places between two tags, or 0."""
        found = bisect_right(places, after)
        return places[found] if found < len(places) and places[found] < end else 0

    @F.arrow_udf(returnType="array<struct<name:string,href:string,price_text:string>>")
    def tiles(html: pa.Array) -> pa.Array:
        offsets, names, targets, prices = [0], [], [], []
        for gaps, tags, ends, ups in pages_of(html):
            tile_at, name_at, price_at, link_at, image_at = [], [], [], [], []
            for k, tag in enumerate(tags, 1):
                facts = tag[facts_at]
                if facts is None:
                    continue
                is_tile, is_named, is_link, is_price, leads, is_image, _ = facts
                if is_tile:
                    tile_at.append(k)
                if is_named or (is_link and any(ups[k - 1])):
                    name_at.append(k)
                if is_price:
                    price_at.append(k)
                if leads:
                    link_at.append(k)
                if is_image:
                    image_at.append(k)

            def text(k: int) -> str:
                return whole(gaps, k, ends[k - 1]) if k else ""

            def own(k: int, name: str) -> str:
                return " ".join((attribute_of(tags[k - 1][facts_at][-1], name) or "").split()) if k else ""

            for k in tile_at:
                end = ends[k - 1]
                name, price, link, image = (first(places, k, end) for places in (name_at, price_at, link_at, image_at))
                names.append(
                    text(name) or own(name, "title") or own(name, "aria-label") or own(link, "title") or own(link, "aria-label")
                    or text(link) or own(image, "alt") or own(image, "title")
                )
                targets.append((attribute_of(tags[link - 1][facts_at][-1], "href") or "") if link else "")
                prices.append(text(price) or text(k))
            offsets.append(len(names))
        found = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (names, targets, prices)], ["name", "href", "price_text"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return tiles


def extract_tiles(pages: DataFrame) -> DataFrame:
    """Product tiles of the shop whose name may sit in a heading, a link or an image.

    The name is the text of the first named place, else of its link's title, label or text, else of its
    image.  The price is the one marked as such, else whatever the tile's text states.
    """
    return _one_row_each(pages, _tile_reader()(F.col("_shown"))).withColumn("name", F.coalesce("name", F.lit("")))


_PAGER = _tagged("", "pagination")
#: The pager, current and active places in it, current and active items, places that lead on, any item.
PAGER_TESTS: tuple[Test, ...] = (
    _PAGER,
    _within(_tagged("", "current"), 0),
    _within(_tagged("", "active"), 0),
    _tagged("li", "current"),
    _tagged("li", "active"),
    _within(_enabled(_tagged("", "next")), 0),
    _enabled(_tagged("", "pagination_next")),
    _enabled(_tagged("li", "next")),
    _tagged("li"),
)


#: Places where the number of the page may stand, each asked for its links first.
NUMBERED = (1, 2, 3, 4)


def _pager_facts() -> Callable[[str, str, str], tuple | None]:
    """Of a link: is it declared as next, does it lead to a page, is it classed as next; None of other elements."""
    _, attribute_of = text_tools()

    def facts(name: str, classes: str, raw: str) -> tuple | None:
        if name != "a":
            return None
        return attribute_of(raw, "rel") == "next", "page=" in (attribute_of(raw, "href") or ""), "next" in classes.lower()

    return facts


def _pager_reader() -> Callable[[Column], Column]:
    """The texts that may state a page's number, in the order they are asked, and whether a page follows."""
    pages_of = page_reader(PAGER_TESTS, _pager_facts())
    _, joined = _said(text_tools()[0])
    numbered, closes_at, passed_at, facts_at = NUMBERED, CLOSES, PASSED, FACTS

    def leads_on(up: Sequence[int], facts: tuple, gaps: Sequence[str], at: int, end: int) -> bool:
        declared, paged, classed = facts
        if up[5] or up[6] or up[7] or declared:
            return True
        if not (paged and (up[0] or up[8])):
            return False
        called = joined(gaps, at, end, " ").lower()
        return classed or "next" in called or "suivant" in called

    @F.arrow_udf(returnType="struct<texts:array<string>,has_next:boolean>")
    def pager(html: pa.Array) -> pa.Array:
        offsets, texts, follows = [0], [], []
        for gaps, tags, ends, ups in pages_of(html):
            first: dict[tuple[int, bool], int] = {}
            more = False
            for k, tag in enumerate(tags, 1):
                if tag[closes_at]:
                    continue
                if tag[facts_at] is not None:
                    up = ups[k - 1]
                    for place in numbered:
                        if up[place]:
                            first.setdefault((place, False), k)
                    more = more or leads_on(up, tag[facts_at], gaps, k, ends[k - 1])
                for place, within in tag[passed_at]:
                    if place in numbered and (within is None or ups[k - 1][within]):
                        first.setdefault((place, True), k)
            texts += [joined(gaps, first[x], ends[first[x] - 1], " ") for x in sorted(first)]
            offsets.append(len(texts))
            follows.append(more)
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(texts, pa.string()))
        return pa.StructArray.from_arrays([listed, pa.array(follows, pa.bool_())], ["texts", "has_next"])

    return pager


def pagination_facts(pages: DataFrame) -> DataFrame:
    """The page the shop says it served (1 when it does not say) and whether one follows.

    The places where the page number may stand are asked in order: links of the pager's current or active place,
    the place itself, then current or active items anywhere.  Only the first of each kind is read, and a kind whose
    first has no number is passed over.  A page follows if an enabled next place holds a link, a link is
    declared as next, or a link of the pager or of an item leads to a page and calls itself next.
    """

    def number(asked: int) -> Column:
        return F.regexp_extract(F.get("_pager.texts", F.lit(asked)), r"(?U)\b(\d+)\b", 1).try_cast("bigint")

    keys = [c for c in pages.columns if c != "html"]
    return (
        shown(pages)
        .select(*keys, _pager_reader()(F.col("_shown")).alias("_pager"))
        .select(
            *keys,
            F.coalesce(*[number(asked) for asked in range(2 * len(NUMBERED))], F.lit(1).cast("bigint")).alias("served_page"),
            F.col("_pager.has_next").alias("has_next"),
        )
    )


# --- listings ----------------------------------------------------------------


def crawl_key(listing: DataFrame) -> list[str]:
    """What names one crawl: shops, and their snapshots, have categories of the same name."""
    return [c for c in ("magasin", "snapshot", "category") if c in listing.columns]


def _believable(name: Column, price: Column, floors: Mapping[str, float] = vocab.PRICE_FLOORS) -> Column:
    table = F.create_map(*[F.lit(p) for pair in floors.items() for p in pair])
    return (name != "") & (price >= F.coalesce(F.try_element_at(table, F.col("magasin")), F.lit(0.0)))


def valid_listing(
    listing: DataFrame, floors: Mapping[str, float] = vocab.PRICE_FLOORS
) -> DataFrame:
    """Named cards with a believable price, the first of each name on a page.

    A shop without a floor keeps all its priced cards.
    """
    priced = listing.withColumns(
        {
            "nom_produit": tx.clean_name(F.col("name")),
            "prix": tx.price_text(F.col("price_text")),
            "url_produit": tx.resolve_url(F.col("href"), F.col("magasin")),
        }
    ).filter(_believable(F.col("nom_produit"), F.col("prix"), floors))
    first = Window.partitionBy(*crawl_key(listing), "page_no", "nom_produit").orderBy("pos")
    return (
        priced.withColumn("_rang", F.row_number().over(first))
        .filter(F.col("_rang") == 1)
        .drop("_rang")
    )


def _placed(listing: DataFrame) -> DataFrame:
    """Rows with their item ``nom`` and ``lien``, whether they show one, and the first page of the crawl that does.

    Rows are dealt by crawl, so what is asked of its pages and items needs no further shuffle.
    """
    key = crawl_key(listing)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*key, "page_no")])
    shown = listing.repartition(*key).withColumns(
        {"nom": tx.clean_name(F.col("name")), "lien": F.trim(F.coalesce("href", F.lit("")))}
    ).withColumn("_montre", whole & ((F.col("nom") != "") | (F.col("lien") != "")))
    first = F.min(F.when(F.col("_montre"), F.col("page_no"))).over(Window.partitionBy(*key, "nom", "lien"))
    return shown.withColumn("_premiere", first)


def _overlap() -> Column:
    """Aggregate: share of a page's shown items that an earlier page showed."""
    repeated = F.count_if(F.col("_montre") & (F.col("_premiere") < F.col("page_no")))
    return F.coalesce(ratio(repeated, F.count_if("_montre")), F.lit(0.0)).alias("recouvrement")


def page_overlap(listing: DataFrame) -> DataFrame:
    """Share of each page's items that an earlier page of the category already showed."""
    return _placed(listing).groupBy(*crawl_key(listing), "page_no").agg(_overlap())


def crawl_pages(listing: DataFrame, threshold: float = OVERLAP_LIMIT) -> DataFrame:
    """One row per page with the first reason, if any, to stop the category there.

    All facts of a page are one aggregate over its rows.  A signature is as long as its page, so the
    per-page lists stay small; a digest of it is what meets the next page's.
    """
    crawl = crawl_key(listing)
    key = [*crawl, "page_no"]
    carded = F.col("pos").isNotNull()
    rank = F.row_number().over(Window.partitionBy(*key, "nom", "_credible").orderBy("pos"))
    pages = (
        _placed(listing)
        .withColumn("_credible", F.coalesce(_believable(F.col("nom"), tx.price_text(F.col("price_text"))), F.lit(False)))
        .withColumn("_valide", F.col("_credible") & (rank == 1))
        .na.drop(subset=key)
        .groupBy(*key)
        .agg(
            F.max("served_page").alias("served_page"),
            F.bool_or("has_next").alias("has_next"),
            F.count_if(carded).alias("_cartes"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        carded & ((F.col("nom") != "") | (F.col("lien") != "")),
                        F.struct("pos", "nom", "lien"),
                    )
                )
            ).alias("_positions"),
            _overlap(),
            F.count_if(F.col("_valide") & F.col("href").isNotNull() & (F.col("_premiere") == F.col("page_no"))).alias("nouveaux"),
        )
        .withColumn("_signature", F.md5(F.to_json(F.transform("_positions", lambda i: F.struct(i.nom, i.lien)))))
        .drop("_positions")
    )
    before = F.lag("_signature").over(Window.partitionBy(*crawl).orderBy("page_no"))
    reason = (
        F.when(F.col("_cartes") == 0, F.lit("page_vide"))
        .when(F.col("served_page") != F.col("page_no"), F.lit("page_redirigee"))
        .when(F.col("_signature") == before, F.lit("page_identique"))
        .when(F.col("recouvrement") >= threshold, F.lit("page_deja_vue"))
        .when((F.col("nouveaux") == 0) & (F.col("page_no") > 1), F.lit("rien_de_nouveau"))
        .when(~F.col("has_next"), F.lit("derniere_page"))
    )
    return pages.withColumn("motif_arret", reason).select(*key, "recouvrement", "nouveaux", "motif_arret")


def crawl_cutoff(listing: DataFrame, threshold: float = OVERLAP_LIMIT) -> DataFrame:
    """Pages up to and with the one where the category's crawl stops."""
    stops = F.min(F.when(F.col("motif_arret").isNotNull(), F.col("page_no"))).over(
        Window.partitionBy(*crawl_key(listing))
    )
    return (
        crawl_pages(listing, threshold)
        .withColumn("_arret", stops)
        .filter(F.col("_arret").isNull() | (F.col("page_no") <= F.col("_arret")))
        .drop("_arret")
    )


def kept_listing(listing: DataFrame, threshold: float = OVERLAP_LIMIT) -> DataFrame:
    """Valid cards of the pages before and at the stop; the stopping page counts."""
    crawl = crawl_key(listing)
    stop = F.min(F.when(F.col("motif_arret").isNotNull(), F.col("page_no"))).alias("_arret")
    stops = crawl_pages(listing, threshold).groupBy(*crawl).agg(stop)
    cards = valid_listing(listing.repartition(*crawl))
    return (
        cards.join(stops, crawl)
        .filter(F.col("page_no").isNotNull() & (F.col("_arret").isNull() | (F.col("page_no") <= F.col("_arret"))))
        .select(*crawl, "page_no", *[c for c in cards.columns if c not in (*crawl, "page_no")])
    )
