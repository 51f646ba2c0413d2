"""Exact Jaccard join over word shingles by grouped prefixes.

A set's elements are put in one global order: shingles, by hash, with very common
ones last.  Two sets with Jaccard similarity of at least t share an element among
their first n - ceil(t n) + 1 elements.  Documents with the same prefix and size
form one group; only groups meet in the join, and members are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalage.llm.common import checked_broadcast, components, dropped, mix, small_batches, word_chunks, written

#: Shingles repeated at least so often are ordered last; the list has a fixed bound.
COMMON_COUNT = 50
COMMON_LIMIT = 100_000
#: Shingles that a task holds to count what repeats among them.
COUNTED = 1 << 22
#: Leaders that a family meets in a turn, turns before all pairs meet that are left,
#: how many pairs for a member a list must still hold to take part in later turns,
#: and one in how many of a turn's pairs must link for another turn.
LEADERS = 3
TURNS = 6
LONG_LIST = 16
WORTH = 16
#: Bits of a set's sketch for a pair, and of the small one that goes with a set's elements in columns of 64.
SKETCH_BITS = 1024
SMALL_SKETCH = ["s0", "s1", "s2", "s3"]
#: Stands for sharing all elements of a prefix.
_WHOLE_PREFIX = 1 << 40


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n that must be looked at for a similarity of percent / 100."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for row, _, found in word_chunks(batch.column("text")):
            for k, tokens in enumerate(found.shingles(words)):
                yield batch, row + k, tokens


def _set_key(tokens: np.ndarray, n: int, seed: int) -> int:
    """A hash of a set of hashes, the same for any order."""
    total = mix(tokens + np.uint64(seed)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(n)).view(np.int64)[0])


def _sketch(tokens: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each of ``bits`` parts of all hashes whether the set has an odd number of them.

    Two sketches differ in at most as many bits as the sets in elements.
    """
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The most repeated shingles of the documents, at most COMMON_LIMIT, the least repeated of them first.

    A task reports what repeats among COUNTED shingles, so little is shuffled.  Whole
    sets are counted: were it only what is in front, a family of near copies would
    meet in the shingles behind.  The list only sets the global order: another list
    gives the same links at another cost.
    """

    def repeats(batches):
        def counted(held):
            token, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(count[keep])], ["token", "n"])

        held, size = [], 0
        for _, _, tokens in _sets(batches, words):
            held.append(tokens)
            size += len(tokens)
            if size > COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    counted = docs.select("text").mapInArrow(repeats, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= COMMON_COUNT).orderBy(F.desc("n"), "token").limit(COMMON_LIMIT).collect()
    return np.array([r.token for r in reversed(rows)], np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n, class_key (of the set), group_key (of prefix and size), prefix, SMALL_SKETCH.

    Shingles in ``common`` come last, in its order; the others by hash before them.
    A task gives a group's prefix once, with its first row that has an id, however many copies it holds.
    """

    order = np.argsort(common)
    known = common[order]

    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "class_key", "group_key")), ("prefix", pa.list_(pa.int64())), *((c, pa.int64()) for c in SMALL_SKETCH)])

    def rows(batches):
        given: set[int] = set()
        out: list[tuple] = []

        def sent():
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch, row, tokens in _sets(batches, words):
            n = len(tokens)
            place = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            late = known[place] == tokens if len(known) else np.zeros(n, bool)
            prefix = np.concatenate([tokens[~late], common[np.sort(order[place[late]])]])[: prefix_length(n, percent)]
            group = _set_key(prefix, n, 2)
            doc = batch.column("doc_id")[row].as_py()
            first = doc is not None and group not in given
            out.append((doc, n, _set_key(tokens, n, 1), group, prefix.view(np.int64) if first else None, *_sketch(tokens, 64 * len(SMALL_SKETCH)).tolist()))
            if first:
                given.add(group)
            if len(out) == 2000:
                yield sent()
                out = []
        yield sent()

    return docs.mapInArrow(rows, "doc_id long, n long, class_key long, group_key long, prefix array<long>, " + ", ".join(f"{c} long" for c in SMALL_SKETCH))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) of class keys whose whole sets reach the similarity, and how many pairs were asked.

    Pairs whose sketches differ too much are left out first.  Texts travel, not sets:
    they are shorter, and their sets are made again.
    """
    pairs = written(pairs, "pairs")
    asked = pairs.count()
    keys = pairs.select(F.explode(F.array("a", "b")).alias("class_key")).distinct()
    needed = written(classes.join(keys, "class_key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "needed")

    def keyed(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            sets = [t for _, _, t in _sets(iter([batch]), words)]
            found = [_set_key(t, len(t), 1) for t in sets], [len(t) for t in sets]
            sketches = pa.array([_sketch(t) for t in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(f, pa.int64()) for f in found), sketches, batch.column("text")], ["class_key", "n", "sketch", "text"])

    def verify(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # bounds the sets held
            sides = [[t for _, _, found in word_chunks(batch.column(c)) for t in found.shingles(words)] for c in ("left", "right")]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides, strict=True)]
            linked = [100 * k >= percent * (len(x) + len(y) - k) for k, x, y in zip(both, *sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    some = docs.join(checked_broadcast(needed, 8), "doc_id", "left_semi").select("text")
    texts = written(some.mapInArrow(keyed, "class_key long, n long, sketch array<long>, text string"), "texts")
    own, other = texts.select(F.col("class_key").alias("a"), "n", "sketch"), texts.select(F.col("class_key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("facing"))
    differ = "aggregate(zip_with(sketch, facing, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    near = written(pairs.join(own, "a").join(other, "b").where(_may_differ(percent, differ)).select("a", "b"), "near")
    left = texts.select(F.col("class_key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("class_key").alias("b"), F.col("text").alias("right"))
    met = near.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    found = written(met.mapInArrow(verify, "a long, b long").distinct(), "verified")
    dropped(pairs, needed, texts, near)
    return found, asked


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _may_link(percent: int) -> str:
    """Whether sets of n and m elements can link, given that they share k prefix elements.

    An element of both is in both prefixes, or behind the end of one of them.
    """
    rest = f"greatest(n - (n - ceil({percent} * n / 100) + 1), m - (m - ceil({percent} * m / 100) + 1))"
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and k + {rest} >= ceil({percent} * (n + m) / {100 + percent})"


def _may_meet(percent: int) -> str:
    """Whether sets of n and m elements whose first shared one is their i-th and j-th (from 0) can link.

    All that they share is there or behind.  Of a linked pair the first shared element
    passes, and with an element all shared ones before it.
    """
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - i, m - j) >= {percent} * (n + m)"


def _may_still_link(percent: int) -> str:
    """Whether they can, given k shared elements of which the i-th and j-th is the last, and no other before it."""
    return f"{100 + percent} * (k + least(n - i, m - j) - 1) >= {percent} * (n + m)"


def _may_differ(percent: int, bits: str) -> str:
    """Whether they can, given in how many bits their sketches differ, which is at most what only one of them has."""
    return f"{100 + percent} * (n + m - ({bits})) >= {2 * percent} * (n + m)"


def _named(links: DataFrame) -> DataFrame:
    """(class_key, component) of all linked classes."""
    return written(components(links).withColumnRenamed("node", "class_key"), "components")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; two documents link when
    100 * intersection >= percent * union of their distinct shingles.  class_id is
    the smallest doc_id with the same set, component_id the smallest reachable by
    links.  Null or empty texts have an empty set and link with nothing; rows
    without a doc_id link with nothing and get null ids; repeated ids and rows are
    kept, other columns are ignored, an empty table gives no rows.  Elements are
    64-bit hashes.

    Members of groups with a common prefix element first meet that element's
    leader only, in some turns with other leaders while that joins components and
    lists of several components stay long, so a family of near copies becomes one
    component without its pairs.  Then members that are still in two components
    meet in the elements that can be the first they share, by their places in both
    sets, unless their sketches differ too much, and are verified if what they share
    up to the last of these allows a link: no link between components is lost.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = common_shingles(docs, words)
    base = written(_prefixes(docs, words, percent, common), "prefixes")
    linked = base.where("n > 0 and doc_id is not null")
    classes = written(linked.groupBy("class_key", "group_key", "n").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in SMALL_SKETCH)), "classes")

    tokens = linked.where("prefix is not null").select("group_key", F.posexplode("prefix").alias("i", "token"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    met = tokens.join(shared, "token").distinct().join(classes, "group_key").select("token", "class_key", "n", "i", F.lit(1).cast("long").alias("k"), *SMALL_SKETCH)
    several = classes.groupBy("group_key").count().where("count > 1").select("group_key")
    alike = classes.join(several, "group_key").select(F.col("group_key").alias("token"), "class_key", "n", F.lit(0).alias("i"), F.lit(_WHOLE_PREFIX).cast("long").alias("k"), *SMALL_SKETCH)
    listed = written(met.union(alike), "listed")

    whole, links, turn, grown = None, None, 0, True
    while True:
        alone = F.col("class_key").alias("component")
        rows = listed.select("*", alone) if whole is None else listed.join(whole, "class_key", "left").select("token", "class_key", "n", "i", "k", *SMALL_SKETCH, F.coalesce("component", "class_key").alias("component"))
        rank = F.xxhash64("class_key", F.lit(turn), F.col("token") % LEADERS)
        lead = F.min(F.struct(rank.alias("rank"), F.col("class_key").alias("other"), F.col("n").alias("m"), F.col("component").alias("own")))
        parts = rows.groupBy("token", "component").agg(F.count("*").alias("c"), lead.alias("lead"))
        lists = parts.groupBy("token").agg(F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("lead").alias("lead"))
        long = (F.col("c") * F.col("c") - F.col("same")) / 2 > LONG_LIST * F.col("c")
        lists = written(lists.where("parts > 1").select("token", long.alias("long"), "lead.other", "lead.m", "lead.own"), "lists")
        mixed = rows.join(lists, "token")
        if turn == TURNS or not grown or turn and not lists.where("long").head(1):
            break
        if turn == 1:  # lists of one component are done
            listed = written(mixed.select("token", "class_key", "n", "i", "k", *SMALL_SKETCH), "listed")
        led = mixed.where("long").drop("long") if turn else mixed
        led = led.where("component <> own").groupBy("class_key", "other", "n", "m").agg((LEADERS * F.sum("k")).alias("k"))
        led = led.where(_may_link(percent)).select(*_ordered("class_key", "other")).distinct()
        found, asked = _verified(docs, classes, led, words, percent)
        grown = WORTH * found.count() >= max(asked, 1)
        links = found if links is None else links.union(found)
        whole, turn = _named(links), turn + 1

    mixed = mixed.select("token", "class_key", "n", "i", "k", "component", *SMALL_SKETCH)
    others = mixed.select("token", F.col("class_key").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("own"), *(F.col(c).alias(f"o{c}") for c in SMALL_SKETCH))
    differ = " + ".join(f"bit_count({c} ^ o{c})" for c in SMALL_SKETCH)
    crossed = mixed.join(others, "token").where("component < own").where(_may_meet(percent)).where(_may_differ(percent, differ))
    counted = crossed.groupBy("class_key", "other", "n", "m").agg(F.sum("k").alias("k"), F.max("i").alias("i"), F.max("j").alias("j")).where(_may_still_link(percent))
    late, _ = _verified(docs, classes, counted.select(*_ordered("class_key", "other")), words, percent)
    whole = _named(links.union(late)) if late.head(1) else whole

    named = classes.join(whole, "class_key", "left").select("class_key", "rep", F.coalesce("component", "class_key").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "component").select("class_key", F.col("rep").alias("class_id"), "component_id")
    alone = F.col("n") == 0
    result = base.select("doc_id", "n", "class_key").join(ids, "class_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    result = written(result, "joined")
    dropped(base, classes, listed, lists, named)
    return result
