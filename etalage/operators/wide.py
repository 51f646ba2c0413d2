"""One column per shop in a single aggregate, and back to one row per shop.

Conditional aggregates over a given list need one shuffle; ``pivot`` would add
a second one, and a job to find the values when no list is given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_prices(
    values: Sequence[str],
    aggregate: Callable[[Column], Column],
    measure: str,
    by: str = "magasin_standardise",
) -> list[Column]:
    """Aggregates of ``measure``, one per value of ``by``, named after the value."""
    return [aggregate(F.when(F.col(by) == v, F.col(measure))).alias(v) for v in values]


def long_rows(df: DataFrame, keep: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One output row per entry of ``rows`` for every input row, next to ``keep``."""
    structs = F.array(*[F.struct(*row) for row in rows])
    return df.select(*keep, F.explode(structs).alias("_r")).select(*keep, "_r.*")
