"""The language model against a plain computation of the same counts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from etalage.llm import quality
from etalage.llm.quality import HELD_OUT, Model, quality_scores


def _plain(trusted, texts):
    """Perplexities by modified Kneser-Ney over pieces, from dictionaries."""

    def grams(text):
        pieces = [int(x) for found, _ in quality._pieces(pa.array([text])) for x in found]
        return list(zip([0, 0, *pieces], [0, *pieces], pieces, strict=False))

    counts = {3: Counter(g for t in trusted for g in grams(t))}
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, sums = {}, {}
    for n, table in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        found = [max(0.1, min(k - 0.1, k - (k + 1) * y * b / a if a else k / 2)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discounts[n] = lambda c, found=found: found[min(c, 3) - 1] if c else 0.0
        sums[n] = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            sums[n][g[:-1]][0] += c
            sums[n][g[:-1]][1] += discounts[n](c)
    total, less = sums[1][()]
    unseen = less / total / (len(counts[1]) + 1)

    def p(g):
        c = counts[len(g)][g]
        if len(g) == 1:
            return (c - discounts[1](c)) / total + unseen
        whole, left = sums[len(g)].get(g[:-1], (0, 0.0))
        return (c - discounts[len(g)](c) + left * p(g[1:])) / whole if whole else p(g[1:])

    out = []
    for text in texts:
        found = grams(text or "")
        out.append(math.exp(-sum(math.log(p(g)) for g in found) / len(found)) if found else None)
    return out


def _texts(n, seed):
    chance = random.Random(seed)
    words = ["the", "internationally", "Übergröße", "кошка", "日本語の", "x1", "and", "a,b", "...", "\n", "😀"]
    return [" ".join(chance.choice(words) for _ in range(chance.randint(1, 40))) for _ in range(n)]


def test_perplexities_equal_a_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 500)
    monkeypatch.setattr(quality, "BUNDLED", 100)
    trusted, texts = _texts(60, 1), [*_texts(50, 2), "never seen words of another kind", "", None, "   ", "the " * 20_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for shards, rounds in ((1, 1), (5, 4)):
        model = Model(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(4), shards)
        got = {r.doc_id: r._perplexity for r in model.perplexities(table, rounds).collect()}
        assert len(got) == len(texts)
        for k, want in enumerate(_plain(trusted, texts)):
            assert got[k] is None if want is None else math.isclose(got[k], want, rel_tol=1e-9), k


def test_model_of_no_texts_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (None, "some text", None), (2, "", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_scores(docs.withColumn("kept", docs.lang).withColumn("_block", docs.lang), labels).collect()
    assert sorted((r.kept, r.threshold) for r in got) == [(False, None), (True, None), (True, None)]
    assert HELD_OUT > 1 and quality_scores(docs.limit(0), labels).count() == 0


def test_numbers_travel_in_the_bytes_they_need():
    for values in (np.ones(1000, np.int64), np.array([0, 255, 3]), np.array([2**40, 1]), np.zeros(3, np.int64), np.zeros(0, np.int64)):
        packed = quality._planes(values)
        assert np.array_equal(next(quality._from_planes(packed)), values)
    assert len(quality._planes(np.ones(1000, np.int64))) < 1100
    for keys in (np.array([5], np.uint64), np.array([1, 2**63, 2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        assert np.array_equal(quality._unpacked(quality._packed(keys)), keys)


def test_the_model_is_not_shuffled_again_to_be_asked(spark):
    model = Model(spark.createDataFrame([(t,) for t in _texts(30, 4)], "text string"), 6)
    docs = quality._in_blocks(spark.createDataFrame(list(enumerate(_texts(5, 5))), "doc_id bigint, text string"))
    plan = quality._answers(docs, model.table, model.shards)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    model.drop()
    assert not spark.catalog.tableExists(model.table.named)
