import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from etalage.functions.numbers import exact_mean, fcfa_text, half_up, percent_text
from etalage.operators.dedupe import keep_first, keep_last
from etalage.operators.stats import grouped_stats, whole

PROBS = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99}


def check_stats(spark, pdf):
    df = spark.createDataFrame(pdf, "g string, v double")
    got = {r.g: r for r in grouped_stats(df, ["g"], "v", PROBS).collect()}
    for g, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
        row = got.pop(None if pd.isna(g) else g)
        assert row.nb == len(part)
        assert abs(row.moyenne - part.v.mean()) < 1e-5
        assert (row.minimum, row.maximum) == (part.v.min(), part.v.max())
        for name, p in PROBS.items():
            assert np.isclose(row[name], part.v.quantile(p), rtol=1e-12, atol=1e-9)
    assert not got


def test_stats_with_a_dominant_group(spark):
    rng = np.random.default_rng(7)
    n = 6000
    groups = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    groups[rng.random(n) < 0.05] = None
    values = np.round(np.exp(rng.normal(6, 2, n)), 2)
    values[rng.random(n) < 0.1] *= -1
    values[:50] = 0.0
    check_stats(spark, pd.DataFrame({"g": groups, "v": values}))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["x", "y"]), st.integers(-500, 500).map(lambda i: i / 4)),
        min_size=1,
        max_size=30,
    )
)
def test_stats_on_any_values(spark, rows):
    check_stats(spark, pd.DataFrame(rows, columns=["g", "v"]))


def test_stats_without_groups(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    row = grouped_stats(df, [], "v", {"m": 0.5}).first()
    assert (row.nb, row.m, row.minimum, row.maximum) == (3, 2.0, 1.0, 4.0)
    assert grouped_stats(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_branches_of_a_whole_aggregate_share_its_shuffle(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    sums = rows.groupBy("g", "v").agg(F.sum(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = [whole(sums, "n", "s").select(c) for c in ("n", "s")]
        plan = both[0].union(both[1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "ReusedExchange" in plan


def test_keep_first_and_last(spark):
    rows = [("k", 2, "b"), ("k", 1, "a"), ("k", None, "z"), ("l", 5, "c")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r.k, r.v) for r in keep_first(df, ["k"], ["o"]).collect()} == {("k", "a"), ("l", "c")}
    assert {(r.k, r.v) for r in keep_last(df, ["k"], ["o"]).collect()} == {("k", "z"), ("l", "c")}
    once = keep_first(df, ["k"], ["o"])
    assert keep_first(once, ["k"], ["o"]).count() == once.count()


def test_dedupe_limits_each_task_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_numbers(spark):
    df = spark.createDataFrame([(1234567.5,), (None,), (-0.04,)], "v double")
    got = [(r[0], r[1]) for r in df.select(fcfa_text(F.col("v")), percent_text(F.col("v"))).collect()]
    assert got[0] == ("1 234 568 FCFA", "1234567.5%")
    assert got[1] == ("-", "-")
    assert df.select(half_up(F.lit(2.675), 2)).first()[0] == 2.68
    thirds = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "v double")
    assert thirds.agg(exact_mean(F.col("v"))).first()[0] == 0.2


def test_large_values_are_not_clipped(spark):
    from etalage.functions.numbers import exact_mean, half_up

    df = spark.createDataFrame([(1e13,), (3e13,)], "x double")
    assert df.agg(exact_mean(F.col("x"))).first()[0] == 2e13
    assert df.agg(F.max(half_up(F.col("x"), 6))).first()[0] == 3e13


def test_shared_folder_needs_the_setting_on_a_cluster():
    import pytest

    from etalage.session import shared_folder

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")
