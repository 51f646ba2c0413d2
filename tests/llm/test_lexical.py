"""Operator 13 against a plain ranking, and its tree's pruning."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from etalage.llm import lexical
from etalage.llm.lexical import FpTree, _Best, ranked_search, search_tree

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str | None) -> Counter:
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def _plain(docs, items) -> list[tuple]:
    counted = [(d, _terms(t)) for d, t in docs]
    held = [(d, c) for d, c in counted if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        wanted = {t: k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, k in _terms(text).items() if df[t]}
        scored = []
        for doc, c in held:
            m = 25 + (75 * c.total() * n) // length
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in wanted.items() if t in c)
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        found += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:10])]
    return found


def _key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 40])
def test_equals_a_plain_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "TREE_DOCUMENTS", 90)
    chance = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "İ", "𝄞x", "Z9"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(chance.choices(words, weights, k=chance.choice([1, 5, 40, 200])))) for k in range(500)]
    docs += [(500 + k, "w3 w4 W5") for k in range(40)]  # copies and ties
    docs += [(3, docs[3][1]), (None, "w1 w2"), (600, None), (601, ""), (602, "-- !!"), (603, "w7 " * 20_000)]
    items = [(k, " ".join(chance.choices(words, k=6))) for k in range(12)] + [(20, "w3 w4 w5"), (21, None), (22, "unknown"), (None, "w9"), (5, "w8 w8")]
    table = spark.createDataFrame(docs, DOCS).repartition(3).withColumn("body", F.lit(1)).withColumn("n", F.lit("x"))
    got = [tuple(r) for r in ranked_search(table, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit(0))).collect()]
    assert sorted(got, key=_key) == sorted(_plain(docs, items), key=_key)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search(none, items).count() == 0
    assert ranked_search(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert ranked_search(some, items).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_bounds_prune_without_loss(kind):
    chance = np.random.default_rng(2)
    paths, counts = [], []
    for _ in range(3_000):
        size = chance.integers(1, 12)
        paths.append(np.unique(np.minimum(chance.geometric(0.08, size) - 1, 49)).astype(np.int32))
        counts.append(chance.integers(1, 9, len(paths[-1])))
    m, ids = chance.integers(30, 300, 3_000), chance.permutation(3_000)
    weights = np.zeros((50, 6), kind)
    weights[30:50, 0], weights[[45, 47], 1], weights[[0, 1], 2], weights[49, 3] = 900, 5_000, 20, 7_000
    best = _Best(6)
    scored = search_tree(FpTree(paths, counts, m, ids), weights, best)
    assert scored <= 3_000
    for item in range(6):
        full = [
            (-int(sum(int(weights[t, item]) * (10**9 * int(c) // (1000 * int(c) + 8 * int(m[d]))) for t, c in zip(paths[d], counts[d], strict=True))), int(ids[d]))
            for d in range(3_000)
        ]
        want = [(-s, d) for s, d in sorted(full)[:10] if s < 0]
        assert [(int(s), int(d)) for s, d in zip(best.scores[item], best.ids[item], strict=True) if s > 0] == want
