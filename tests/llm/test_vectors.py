"""Vectors and lists at their edges."""

import pytest

from etalage.llm.licenses import license_scan
from etalage.llm.topk import top_k
from etalage.llm.vector_dedup import vector_dedup

KIND = "vec_id bigint, embedding array<double>"


def test_an_id_with_a_usable_and_an_unusable_row_keeps_both(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = vector_dedup(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)
    ]


def test_scores_beyond_64_bits_fail(spark):
    table = spark.createDataFrame([(k, [k * 1e18, 1.0]) for k in range(1, 9)], KIND)
    with pytest.raises(Exception, match="too long for scores"):
        top_k(table, table).collect()


def test_a_list_without_notices_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to any person")], "doc_id bigint, text string")
    assert license_scan(docs, notices=()).count() == 0
