"""Keep one row per key, with an order that decides which.

``dropDuplicates`` keeps whichever row arrives first; these keep a defined one.
Spark plans ``row_number() = 1`` with a group limit below the shuffle, so each
map task sends at most one row per key: a key that holds a large share of the
table costs one row per task, not its whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rang_dans_cle"


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in ascending order, nulls last."""
    return _pick(df, keys, [F.col(c).asc_nulls_last() for c in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key in ascending order with nulls last."""
    return _pick(df, keys, [F.col(c).desc_nulls_first() for c in order])
