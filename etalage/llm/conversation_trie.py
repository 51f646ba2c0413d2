"""The prefix trie of conversations, from adaptive radix trees over ranges of their keys.

A turn becomes a fixed-width big-endian id, the digest of its role and text, and a conversation
the string of its ids.  Sorted by key and conversation, every task holds one contiguous range and
builds a radix tree of it, streaming over copies.  A node whose members lie in one range is complete there.
Only nodes on the way to a range's first or last key can go on in another range: these, at most
two paths a range, are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import checked_broadcast, dropped, written
from etalage.llm.radix_tree import Node, RadixTree

#: Bytes of a turn id: the MD5 digest of the turn's role and text.
ID_BYTES = 16
#: Ids that end at one node are joined to texts of so many.
PIECE_IDS = 8_192
#: A conversation takes over the head of the first of each block of so many ids.
BLOCK, HEADS = 20, 4

#: A row is a complete node, a part of a node on a range's edge (``node`` is set), or a piece of the ends of such a node.
PARTS = pa.schema(
    [
        ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
        ("depth", pa.int64()), ("words", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ]
)
_PARTS_DDL = (
    "node binary, parent binary, conv_id bigint, parent_conv_id bigint, depth bigint, words bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
)
_SPINE_DDL = "node binary, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
_SPINE = pa.schema(
    [("node", pa.binary())]
    + [(n, pa.int64()) for n in ("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
)
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): the turn ids of every rebuilt conversation, and the words of each turn.

    Turns are dealt by block once; a block's head and its conversations then lie together.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        base.alias("_base"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    )
    own = turns.repartition("_base").groupBy("_base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("_base"), F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy("_base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    heads = F.coalesce(F.slice("_head", 1, F.col("_h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))

    def key(turns: Column) -> Column:
        return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), ""))

    return (
        own.withColumn("_head", head)
        .withColumn("_h", h)
        .select("conv_id", F.concat(heads, rest).alias("turns"))
        .select("conv_id", key(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    )


class _Ends:
    """The conversations of one key: their ids in ascending order, and the words of the key's turns."""

    __slots__ = ("ids", "words")

    def __init__(self, words: list[int]) -> None:
        self.ids: list[np.ndarray] = []
        self.words = words

    def count(self) -> int:
        return sum(map(len, self.ids))

    def pieces(self, size: int) -> Iterator[tuple[int, str]]:
        """The ids as joined text, with the first id of each piece."""
        for ids in self.ids:
            for at in range(0, len(ids), size):
                part = ids[at : at + size].tolist()
                yield part[0], ",".join(map(str, part))

    def digest(self) -> str:
        sha = hashlib.sha256()
        for k, (_, text) in enumerate(self.pieces(PIECE_IDS)):
            sha.update(("," + text if k else text).encode())
        return sha.hexdigest()


class _Sums:
    """Totals of a node's subtree within one range; on a range's edge only of its complete nodes."""

    __slots__ = ("count", "least", "words", "tops", "leaves", "saved")

    def __init__(self) -> None:
        self.count, self.least, self.words = 0, None, None
        self.tops = self.leaves = self.saved = 0  # tops: topmost trie nodes


class _Rows:
    """Rows for PARTS, handed over in batches."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in PARTS]

    def add(self, *values: object) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            full, self.columns = self.columns, [[] for _ in PARTS]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(full, PARTS, strict=True)], schema=PARTS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Scalar, np.ndarray]]:
    """(key, words, ids) of each run of equal keys within a batch; a long run comes in several."""
    for batch in batches:
        keys, ids, words = batch["key"].to_pylist(), batch["conv_id"].to_numpy(), batch["words"]
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                yield keys[start], words[start], ids[start:at].copy()
                start = at


def _digest(key: bytes, depth: int) -> bytes:
    return hashlib.md5(key[: depth * ID_BYTES]).digest()


def _summed(tree: RadixTree, edge_nodes: set[Node]) -> dict[Node, tuple[int, int, _Sums]]:
    """For every node the turn depths of its edge, (above, below], and its totals; children first."""
    order, stack = [], [(tree.root, 0)]
    while stack:
        node, top = stack.pop()
        bottom = top + len(node.edge)
        order.append((node, top, bottom))
        stack.extend((kid, bottom) for kid in node.branches())
    found: dict[Node, tuple[int, int, _Sums]] = {}
    for node, top, bottom in reversed(order):
        sums = _Sums()
        if node.value is not None:
            sums.count, sums.least, sums.words = node.value.count(), int(node.value.ids[0][0]), node.value.words
        for kid in node.branches():
            above, below, its = found[kid]
            sums.count += its.count
            sums.least = its.least if sums.least is None else min(sums.least, its.least)
            sums.words = its.words if sums.words is None else sums.words
            if kid not in edge_nodes or below == above:
                # a trie node on the range's edge is added when its parts are merged
                sums.leaves, sums.saved = sums.leaves + its.leaves, sums.saved + its.saved
                sums.tops += its.tops if below == above else 1
        above, below = top // ID_BYTES, bottom // ID_BYTES
        if node not in edge_nodes:
            sums.leaves = sums.leaves if sums.tops else 1
            if sums.count > 1:
                sums.saved += (sums.count - 1) * sum(sums.words[above:below])
        found[node] = above, below, sums
    return found


def trie_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one sorted range of (key, conv_id): complete ones, and parts of those on its edges."""
    tree, rows = RadixTree(), _Rows()
    first = last = ends = None
    for key, words, ids in _runs(batches):
        if key != last:
            node = tree.insert(key)
            node.value = ends = _Ends(words.as_py())
            first, last = key if first is None else first, key
        ends.ids.append(ids)
    if last is None:
        return
    edge_nodes = {*tree.path(first), *tree.path(last)}
    found = _summed(tree, edge_nodes)
    # (node, a key that leads to it, parent on an edge, smallest member of a complete parent)
    stack: list[tuple[Node, bytes, bytes | None, int | None]] = [(tree.root, b"", None, None)]
    while stack:
        node, key, parent, parent_conv = stack.pop()
        key = key + node.edge
        above, below, sums = found[node]
        on_edge = node in edge_nodes
        depths = range(0, 1) if node is tree.root else range(above + 1, below + 1)
        saved = sums.saved
        for depth in depths:
            deepest = depth == below
            words = sums.words[depth - 1] if depth else 0
            if on_edge:
                mark = _digest(key, depth)
                rows.add(
                    mark, parent, sums.least, None, depth, words, sums.count,
                    *((sums.tops, sums.leaves, sums.saved) if deepest else (0, 0, 0)), None,
                )
                parent, parent_conv = mark, None
            else:
                rows.add(
                    None, parent, sums.least, parent_conv, depth, words, sums.count,
                    sums.tops if deepest else 1, sums.leaves, saved,
                    node.value.digest() if deepest and node.value is not None else None,
                )
                saved -= (sums.count - 1) * words
                parent, parent_conv = None, sums.least
        if on_edge and node.value is not None:
            for least, text in node.value.pieces(PIECE_IDS):
                rows.add(mark if depths else parent, None, least, None, None, None, None, None, None, None, text)
        yield from rows.batches(20_000)
        stack.extend((kid, key, parent, parent_conv) for kid in node.branches())
    yield from rows.batches(1)


def merged_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that lie on edges of ranges, complete: own sums, then those of their children on edges.

    At most two paths a range come here, summed by node: their number follows the ranges and the
    longest conversation, not the rows.
    """
    nodes = {row["node"]: row for batch in batches for row in batch.to_pylist()}
    for row in sorted(nodes.values(), key=lambda r: -r["depth"]):
        row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
        row["n_leaves"] = row["n_leaves"] if row["n_children"] else 1
        above = nodes.get(row["parent"])
        row["parent_conv_id"] = above and above["conv_id"]
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    names = [f.name for f in _SPINE]
    yield pa.record_batch(
        [pa.array([row[n] for row in nodes.values()], _SPINE.field(n).type) for n in names], schema=_SPINE
    )


def ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) of pieces sorted by node and first id: one pass, however many conversations end there."""
    node = sha = None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for mark, text in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if mark != node:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = mark, hashlib.sha256()
                sha.update(text.encode())
            else:
                sha.update(("," + text).encode())
    if node is not None:
        done.append((node, sha.hexdigest()))
    yield pa.record_batch(
        [pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["node", "ends"]
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations; (conv_id, depth) is its key.

    A conversation's turns are ordered by turn, a null turn first; equal turns by role, then by turn
    id.  Null roles and texts are empty; rows without a conv_id take no part.  Repeated rows are repeated turns.
    Remainders of negative ids have the sign of the id, as in SQL.  An empty table gives no node, not even a
    root.  Other columns are ignored.

    One conversation lies in one task; copies of a conversation are spread over ranges by their id.
    Turns of different content are told apart by 128-bit digests.  The digest over all the ids that
    end at one node is a chain by its nature: one task streams them, already joined to pieces.
    """
    rebuilt = written(rebuilt_conversations(conversations), "rebuilt")
    ranges = rebuilt.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = written(ranges.mapInArrow(trie_parts, _PARTS_DDL), "trie")
    dropped(rebuilt)
    on_edge = parts.where("node IS NOT NULL AND n_convs IS NOT NULL").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    edges = written(on_edge.repartition(1).mapInArrow(merged_edges, _SPINE_DDL), "edges")
    ends = (
        parts.where("node IS NOT NULL AND n_convs IS NULL").select("node", "conv_id", "ends")
        .repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends")
        .mapInArrow(ends_digests, "node binary, ends string")
    )
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    whole = parts.where("node IS NULL")
    parents = checked_broadcast(edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above")), 64)
    return (
        whole.where("parent IS NULL").select(*columns)
        .union(whole.where("parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("_above")).select(*columns))
        .union(edges.join(ends, "node", "left").select(*columns))
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(_NONE)))
        .drop("ends")
    )
