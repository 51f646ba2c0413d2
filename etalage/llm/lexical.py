"""Ranked lexical search: document FP-trees, searched depth first with bounds.

Documents keep only the terms that the items name, most frequent first, so that documents share
paths from the root.  A subtree knows the largest frequency of each of its terms and its least
length factor m: no document below scores more than these would.  Each task builds trees of its own
documents and searches every item in them; items whose bound stays below their tenth best are dropped
from a subtree, subtrees without items are not entered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import dropped, small_batches, written

#: Best documents of an item.
TOP = 10
#: Items are searched in blocks whose texts have about so many bytes, one item at least.
BLOCK_BYTES = 4 << 20
#: Documents of one tree, and of a subtree that is scored at once.
TREE_DOCUMENTS, LEAF_DOCUMENTS = 4_096, 24
#: Sums below this are exact in doubles.
EXACT = 2**53
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_VECTORS_DDL = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms in order; only A-Z are lower-cased.  Bytes of other characters belong to terms."""
    return TERM.findall((text or "").encode().lower())


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about BLOCK_BYTES, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col(key), F.col(text)).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """Per document its number of terms and the frequencies of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = known.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for body in batch["body"]:
                found = terms_of(body.as_py())
                sizes.append(len(found))
                mine = [(places[t], c) for t, c in Counter(found).items() if t in places]
                terms.append([t for t, _ in mine])
                counts.append([c for _, c in mine])
            yield pa.record_batch(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.select("doc_id", F.col(text).alias("body")).mapInArrow(count, _VECTORS_DDL)


class _Subtree:
    """Documents [start, end) of a sorted tree, with its terms' largest frequencies and the least m."""

    __slots__ = ("start", "end", "kids", "terms", "most", "least")

    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end
        self.kids: list[_Subtree] = []


class FpTree:
    """An FP-tree over some documents' terms, most frequent first; paths without branches are one step.

    Built over sorted documents: a subtree is a range of them.  Ranges of at most LEAF_DOCUMENTS are not divided.
    """

    def __init__(self, paths: list[np.ndarray], counts: list[np.ndarray], m: np.ndarray, ids: np.ndarray) -> None:
        order = sorted(range(len(paths)), key=lambda d: paths[d].tolist())
        self.paths = [paths[d] for d in order]
        self.counts = [counts[d] for d in order]
        self.m, self.ids = m[order], ids[order]
        shared = [0] * len(order)  # terms that a document's path shares with the one before
        for d in range(1, len(order)):
            a, b = self.paths[d - 1], self.paths[d]
            size = min(len(a), len(b))
            differ = np.flatnonzero(a[:size] != b[:size])
            shared[d] = int(differ[0]) if len(differ) else size
        self.root = _Subtree(0, len(order))
        made, todo = [], [self.root]
        while todo:
            tree = todo.pop()
            made.append(tree)
            if tree.end - tree.start <= LEAF_DOCUMENTS:
                continue
            inner = shared[tree.start + 1 : tree.end]
            depth = min(inner)
            cuts = [tree.start, *(tree.start + 1 + k for k, s in enumerate(inner) if s == depth), tree.end]
            if len(cuts) - 1 == tree.end - tree.start and depth == len(self.paths[tree.start]) == len(self.paths[tree.end - 1]):
                # equal paths: nothing tells the documents apart, so halves keep the leaves small
                middle = (tree.start + tree.end) // 2
                cuts = [tree.start, middle, tree.end]
            tree.kids = [_Subtree(a, b) for a, b in _gathered(cuts)]
            todo.extend(tree.kids)
        for tree in reversed(made):
            self._bound(tree)

    def _bound(self, tree: _Subtree) -> None:
        if tree.kids:
            terms = np.concatenate([k.terms for k in tree.kids])
            counts = np.concatenate([k.most for k in tree.kids])
            tree.least = min(k.least for k in tree.kids)
        else:
            terms = np.concatenate(self.paths[tree.start : tree.end])
            counts = np.concatenate(self.counts[tree.start : tree.end])
            tree.least = int(self.m[tree.start : tree.end].min())
        order = np.argsort(terms, kind="stable")
        terms, counts = terms[order], counts[order]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        tree.terms = terms[starts]
        tree.most = np.maximum.reduceat(counts, starts) if len(terms) else counts


def _gathered(cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring small ranges together, as far as they fit a leaf."""
    start = cuts[0]
    for before, end in zip(cuts[1:-1], cuts[2:], strict=True):
        if end - start > LEAF_DOCUMENTS:
            yield start, before
            start = before
    yield start, cuts[-1]


class _Best:
    """The best documents of every item so far, equal scores by doc_id."""

    def __init__(self, items: int) -> None:
        self.scores = np.zeros((items, TOP), np.int64)
        self.ids = np.zeros((items, TOP), np.int64)
        self.floor = np.ones(items, np.int64)  # the least score that could enter

    def offer(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns)."""
        for column in np.flatnonzero((scores >= self.floor[items]).any(axis=0)):
            item = items[column]
            rows = np.flatnonzero(scores[:, column] >= self.floor[item])
            s = np.concatenate([self.scores[item], scores[rows, column].astype(np.int64)])
            d = np.concatenate([self.ids[item], ids[rows]])
            kept = np.lexsort((d, -s))[:TOP]
            self.scores[item], self.ids[item] = s[kept], d[kept]
            self.floor[item] = max(1, s[kept[-1]])


def _gain(counts: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * counts) // (1_000 * counts + 8 * m)


def search_tree(tree: FpTree, weights: np.ndarray, best: _Best) -> int:
    """Depth-first branch and bound for all items at once; returns the number of documents scored.

    ``weights`` has a row per term and a column per item: the weight times the item's repeats.  Subtrees
    of equal bound are entered, as a smaller doc_id may wait there.
    """
    scored = 0
    stack = [(tree.root, np.arange(weights.shape[1]))]
    while stack:
        sub, items = stack.pop()
        bound = _gain(sub.most, sub.least).astype(weights.dtype) @ weights[sub.terms]
        items = items[bound[items] >= best.floor[items]]
        if not len(items):
            continue
        if sub.kids:
            # the last is visited first: subtrees of short documents with frequent terms
            stack.extend((kid, items) for kid in sorted(sub.kids, key=lambda k: (-k.least, k.start)))
            continue
        size = sub.end - sub.start
        scored += size
        gains = np.zeros((size, len(sub.terms)), weights.dtype)
        for row in range(size):
            d = sub.start + row
            gains[row, np.searchsorted(sub.terms, tree.paths[d])] = _gain(tree.counts[d], int(tree.m[d]))
        best.offer(items, gains @ weights[sub.terms][:, items], tree.ids[sub.start : sub.end])
    return scored


def best_of_tasks(vectors: DataFrame, rank: list[int], weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item.

    ``rank`` orders the terms by falling document frequency; the rows of ``weights`` follow it.
    """
    held = vectors.sparkSession.sparkContext.broadcast((np.array(rank, np.int32), weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, weight = held.value
        best = _Best(weight.shape[1])

        def solve(rows: list[tuple[int, int, list[int], list[int]]]) -> None:
            paths, counts = [], []
            for _, _, terms, found in rows:
                place = ranks[np.array(terms, np.int64)]
                order = np.argsort(place)
                paths.append(place[order])
                counts.append(np.array(found, np.int64)[order])
            m = np.array([25 + (75 * n * n_docs) // n_terms for _, n, _, _ in rows], np.int64)
            search_tree(FpTree(paths, counts, m, np.array([r[0] for r in rows], np.int64)), weight, best)

        rows: list[tuple[int, int, list[int], list[int]]] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                rows.append(row)
                if len(rows) == TREE_DOCUMENTS:
                    solve(rows)
                    rows = []
        if rows:
            solve(rows)
        item, place = np.nonzero(best.scores)
        yield pa.record_batch(
            [pa.array(item.astype(np.int32)), pa.array(best.ids[item, place]), pa.array(best.scores[item, place])],
            names=["item", "doc_id", "score"],
        )

    useful = vectors.where("doc_id IS NOT NULL AND size(terms) > 0")
    return useful.mapInArrow(search, "item int, doc_id bigint, score bigint")


def _weights(block: list[tuple[object, str | None]], vocabulary: dict[bytes, int], df: dict[int, int], n_docs: int) -> tuple[list[int], np.ndarray]:
    order = sorted(range(len(vocabulary)), key=lambda t: (-df.get(t, 0), t))
    rank = [0] * len(order)
    for place, term in enumerate(order):
        rank[term] = place
    exact = np.zeros((len(vocabulary), len(block)), np.int64)
    for column, (_, text) in enumerate(block):
        for term, repeats in Counter(terms_of(text)).items():
            if t := df.get(vocabulary[term], 0):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * t + 1)))
                exact[rank[vocabulary[term]], column] = repeats * weight
    # a term gains less than a million: where all sums stay exact in doubles, doubles are faster
    small = not exact.size or int(exact.sum(axis=0).max()) * 1_000_000 < EXACT
    return rank, exact.astype(np.float64) if small else exact


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ten best documents with a score above 0.

    Null texts have no terms.  Documents without an id count in the statistics but are not returned;
    repeated rows are documents of their own, and repeated items are ranked once each.  Equal scores go by
    doc_id.  Empty tables, and items that share no term with any document, give no rows.  Other
    columns are ignored.

    The items, a stated query set, go to the tasks in blocks of about BLOCK_BYTES of text; the documents
    are read once a block.  Each task passes on ten rows an item at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema[item_id].dataType.simpleString()
    found: DataFrame | None = None
    for block in _item_blocks(items, item_id, item_text):
        vocabulary: dict[bytes, int] = {}
        for _, body in block:
            for term in terms_of(body):
                vocabulary.setdefault(term, len(vocabulary))
        vectors = written(restricted_vectors(docs, vocabulary, text), "vectors")
        n_docs, n_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = {
            r.term: r.df
            for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        }
        rank, weights = _weights(block, vocabulary, df, n_docs)
        best = written(best_of_tasks(vectors, rank, weights, n_docs, n_terms), "best")
        dropped(vectors)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        names = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(block)], f"item int, item_id {kind}")
        ranked = (
            best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
            .join(names, "item").select("item_id", "rank", "doc_id", "score")
        )
        found = ranked if found is None else found.union(ranked)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return found
