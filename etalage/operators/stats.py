"""Exact grouped statistics, quantiles included, without a one-task group.

``median`` and ``percentile`` keep every distinct value of a group in one
task's memory.  Here a group is never brought together:

1. rows are counted per (group, value) with map-side combine;
2. values fall into ordered buckets of about 3 % width, and the buckets' counts
   tell which bucket holds each wanted rank (a few hundred rows per group);
3. only those buckets are ranked value by value, and the order statistics on
   both sides of the wanted rank are interpolated linearly.

Count, mean, minimum and maximum come from the same bucket table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalage.functions.numbers import mean_of, micro_units

_BUCKETS_PER_E_FOLD = 32.0
#: Magnitudes below this share one bucket; the shift keeps all others above it.
_LEAST, _SHIFT = 1e-300, 700.0


def _bucket(value: Column) -> Column:
    """An integer that never decreases when the value grows; shares and amounts alike fall apart."""
    scaled = (F.ln(F.abs(value)) + F.lit(_SHIFT)) * F.lit(_BUCKETS_PER_E_FOLD)
    size = F.when(F.abs(value) > _LEAST, F.floor(scaled)).otherwise(0).cast("int")
    return F.when(value < 0, -size - 1).otherwise(size)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` with null equal to null, keys kept once."""
    renamed = right.withColumnsRenamed({k: f"_d_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_d_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_d_{k}" for k in keys])


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``groups``, each non-null value as ``_v`` and its number of rows as ``_c``."""
    kept = df.filter(F.col(value).isNotNull())
    return kept.groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def whole(df: DataFrame, *sums: str) -> DataFrame:
    """The aggregate with its sums, none of them null, needed by every branch that reads it.

    Branches that need different columns would each plan the aggregate, and all
    below it, anew; with the same columns they share one shuffle.
    """
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in sums]))


def grouped_stats(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
) -> DataFrame:
    """``groups``, ``nb``, ``moyenne``, ``minimum``, ``maximum`` and the named quantiles.

    Rows whose value is null are left out.  With no groups the result is one
    row, or none for an empty input.
    """
    return counted_stats(value_counts(df, groups, value), groups, quantiles)


def counted_stats(
    counts: DataFrame, groups: Sequence[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """``grouped_stats`` of values that are counted already (see ``value_counts``)."""
    keys = list(groups)
    counted = counts.withColumn("_b", _bucket(F.col("_v")))
    by_group = Window.partitionBy(*keys)
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(
            F.sum("_c").alias("_bc"),
            F.sum(micro_units(F.col("_v")) * F.col("_c").cast("decimal(18,0)")).alias("_bs"),
            F.min("_v").alias("_bmin"),
            F.max("_v").alias("_bmax"),
        )
        .withColumns(
            {
                "_below": F.sum("_bc").over(by_group.orderBy("_b")) - F.col("_bc"),
                "nb": F.sum("_bc").over(by_group),
            }
        )
    )
    ranks = {
        name: (F.floor(F.lit(p) * (F.col("nb") - 1)), F.ceil(F.lit(p) * (F.col("nb") - 1)))
        for name, p in quantiles.items()
    }
    hit = reduce(
        lambda a, b: a | b,
        [
            (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_bc"))
            for pair in ranks.values()
            for rank in pair
        ],
    )
    totals = buckets.groupBy(*keys).agg(
        F.max("nb").alias("nb"),
        mean_of(F.sum("_bs"), F.sum("_bc")).alias("moyenne"),
        F.min("_bmin").alias("minimum"),
        F.max("_bmax").alias("maximum"),
    )
    ranked = (
        join_null_safe(
            counted, buckets.filter(hit).select(*keys, "_b", "_below", "nb"), [*keys, "_b"]
        )
        .withColumn(
            "_end",
            F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")),
        )
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    columns = []
    for name, p in quantiles.items():
        low, high = ranks[name]
        part = F.max(F.lit(p) * (F.col("nb") - 1) - low)
        columns.append((at(low) + (at(high) - at(low)) * part).alias(name))
    if not groups:
        whole = totals.select(F.struct("*")).scalar()
        alone = ranked.agg(*columns).withColumn("_total", whole).filter("_total.nb IS NOT NULL")
        return alone.select("_total.*", *quantiles)
    result = join_null_safe(totals, ranked.groupBy(*keys).agg(*columns), keys)
    return result.select(*groups, "nb", "moyenne", "minimum", "maximum", *quantiles)
