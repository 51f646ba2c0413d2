"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable() -> Column:
    """Whether a row has an id and a vector of finite components; never null."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    return embeddings.where(is_usable())


def matrix(column, width: int) -> np.ndarray:
    """A list column as a matrix of doubles; shorter vectors end in zeros."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        column = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    for k, vector in enumerate(column):
        out[k, : len(vector)] = vector
    return out


def centres(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Means of ``count`` groups of a bounded sample (Lloyd's steps from its first rows)."""
    found = np.unique(sample, axis=0)[:: max(1, len(sample) // max(count, 1))][:count].copy()
    for _ in range(rounds):
        near = ((found**2).sum(1) - 2 * sample @ found.T).argmin(1)
        size = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found[size > 0] = sums[size > 0] / size[size > 0, None]
    return found
