"""Spark against SQL on the smallest driver tables; ``checks.compare`` covers every query."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
SOME = (
    "analytics",
    "competitiveness",
    "category_store_score",
    "price_comparison",
    "dispersion",
    "crawl_cutoff",
    "category_suggestions",
    "quality_report",
)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
