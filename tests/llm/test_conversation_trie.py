"""Operator 12 against a plain trie, and its radix tree against a dictionary."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from etalage.llm.conversation_trie import conversation_trie
from etalage.llm.radix_tree import RadixTree

ROWS = "conv_id bigint, turn bigint, role string, text string"


def _plain(rows) -> set[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = own.get(conv - conv % 20, [])
        made = tuple(base[:h] + turns[h:])
        for depth in range(len(made) + 1):
            members[made[:depth]].append(conv)
            words[made[:depth]] = len(re.findall(r"[^\x20\x09-\x0D]+", made[depth - 1][1])) if depth else 0
        ends[made].append(conv)
    kids = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * words[node]
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return {
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    }


def _check(spark, rows, partitions: str = "7") -> None:
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, ROWS).withColumn("depth", F.lit("x")).withColumn("key", F.lit(1))
        got = [tuple(r) for r in conversation_trie(table).select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert len(got) == len(set(got)) and set(got) == _plain(rows)


def test_a_trie_over_many_ranges_equals_a_plain_one(spark):
    chance = random.Random(3)
    rows = []
    for conv in range(400):
        turns = chance.choice([0, 1, 2, 3, 6]) if conv % 7 else 4
        for turn in range(turns):
            text = "same words here" if conv % 7 == 0 else f"t{turn} " + chance.choice(["a", "b b", "c c c", ""])
            rows.append((conv, turn if turn else None, chance.choice(["user", None]) if turn == 1 else "user", text))
    _check(spark, rows, "13")


def test_copies_spread_over_ranges(spark):
    rows = [(conv, turn, "user", f"turn {turn}") for conv in range(500) for turn in range(5)]
    rows += [(1_000 + conv, turn, "user", f"turn {turn} {conv if turn > 2 else ''}") for conv in range(50) for turn in range(9)]
    _check(spark, rows, "11")


def test_edges(spark):
    long = "word " * 30_000
    rows = [
        (None, 0, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 1, "a", long), (3, 1, "a", long),
        (20, 0, "user", "head"), (21, 5, "user", ""), (-5, 0, "user", "neg"), (40, 0, "ab", "c"), (60, 0, "a", "bc"),
    ]
    got = {(r.conv_id, r.depth): r for r in conversation_trie(spark.createDataFrame(rows, ROWS)).collect()}
    assert {k for k, r in got.items() if r.depth == 0} == {(-5, 0)} and got[(-5, 0)].n_convs == 6
    assert (40, 1) in got and (60, 1) in got  # role and text do not run together
    assert conversation_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], ROWS)).count() == 0


def test_radix_tree_layouts_and_paths():
    chance = random.Random(1)
    keys = {bytes(chance.randrange(256) for _ in range(chance.choice([0, 1, 2, 8]))) for _ in range(3_000)}
    keys |= {b"ab" * k for k in range(20)} | {bytes([b]) + b"tail" for b in range(256)}
    tree = RadixTree()
    for key in sorted(keys):
        tree.insert(key).value = key
    found, stack, layouts = [], [(tree.root, b"")], set()
    while stack:
        node, above = stack.pop()
        key = above + node.edge
        layouts.add("sorted" if node.keys is not None else "indexed" if node.index is not None else "full")
        kids = list(node.branches())
        assert len(kids) != 1 or node.value is not None or node is tree.root  # paths are compressed
        if node.value is not None:
            assert node.value == key
            found.append(key)
        stack.extend((kid, key) for kid in reversed(kids))
    assert found == sorted(keys) and "full" in layouts and "sorted" in layouts
    small = RadixTree()
    for byte in range(30):
        small.insert(bytes([byte * 7 % 256]))
    assert small.root.index is not None and len(list(small.root.branches())) == 30
    assert small.path(bytes([7]))[-1].edge == bytes([7])
