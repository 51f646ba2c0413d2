"""Exact top-k by inner product: a Voronoi join.

With one more component, sqrt(max |x|^2 - |x|^2) for data and 0 for queries, the
largest inner products are the smallest Euclidean distances.  Queries and data are
grouped by pivots in that space; distances to pivots give every query cell a radius
in which its queries' neighbours must lie, and only data inside it go there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import written
from etalage.llm.vectors import centres, matrix, usable

K = 5
PIVOTS = 48
#: Rows that pivots are chosen from, at most.
MAX_SAMPLE = 4_096
#: Queries and data rows that meet in one task, at most (about).
QUERY_BLOCK = 2_048
DATA_BLOCK = 4_096
#: Fixed value of the score: components are floor(SCALE * x).
SCALE = 256


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the usable rows, in whole steps; fails where n components pass 2^31 / sqrt(n) steps, as scores could wrap."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    # so many components of at most this size have products that a 64-bit integer holds
    fits = F.forall(whole, lambda v: F.abs(v) <= F.sqrt(F.lit(2.0**62) / F.size("embedding")))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a vector is too long for scores of 64 bits")).cast("array<double>"))
    return usable(embeddings).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("vector"))


def _distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.concatenate([points, extra[:, None]], axis=1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _summaries(rows: DataFrame, pivots: np.ndarray, width: int, top: float | None, k: int) -> pd.DataFrame:
    """For each cell: rows, largest distance and the k smallest distances of different ids (as lists).

    Tasks sum up their own rows; what is gathered is bounded by pivots and k.
    """

    def smallest(away, ids):
        order = np.argsort(away, kind="stable")
        first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
        return away[order][first], ids[order][first]

    def summarise(batches):
        near, size, far = [(np.zeros(0), np.zeros(0, np.int64))] * len(pivots), np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for batch in batches:
            points, ids = matrix(batch.column("vector"), width), batch.column("vec_id").to_numpy()
            extra = np.zeros(len(points)) if top is None else np.sqrt(np.maximum(top - (points**2).sum(1), 0))
            away = _distances(points, extra, pivots)
            cell = away.argmin(1) if len(points) else np.zeros(0, int)
            for c in np.unique(cell):
                own = away[cell == c, c]
                near[c] = smallest(np.concatenate([near[c][0], own]), np.concatenate([near[c][1], ids[cell == c]]))
                size[c] += len(own)
                far[c] = max(far[c], own.max())
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(far[some]), *(pa.array([near[c][k] for c in some], pa.list_(t)) for k, t in enumerate((pa.float64(), pa.int64())))], ["cell", "size", "far", "near", "ids"])

    parts = rows.select("vec_id", "vector").mapInArrow(summarise, "cell long, size long, far double, near array<double>, ids array<long>")
    parts = written(parts, "cells")
    sums = parts.groupBy("cell").agg(F.sum("size").alias("size"), F.max("far").alias("far"))
    first = F.row_number().over(Window.partitionBy("cell").orderBy("d", "id"))
    least = parts.select("cell", F.explode(F.arrays_zip(F.col("near").alias("d"), F.col("ids").alias("id"))).alias("x")).groupBy("cell", F.col("x.id").alias("id")).agg(F.min("x.d").alias("d"))
    least = least.withColumn("n", first).where(F.col("n") <= k).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("x"))
    least = least.select("cell", F.col("x.d").alias("near"), F.col("x.id").alias("ids"))
    return sums.join(least, "cell").orderBy("cell").toPandas()


def radii(pivots: np.ndarray, queries: pd.DataFrame, data: pd.DataFrame, k: int) -> dict[int, float]:
    """For each query cell the distance from its pivot beyond which no neighbour can be.

    Rows of k different ids lie within; a query's own id is one of them at most.
    """
    ids = np.concatenate([np.array(x, np.int64) for x in data["ids"]])
    out = {}
    for cell, reach in zip(queries["cell"], queries["far"], strict=True):
        apart = np.sqrt(((pivots[data["cell"]] - pivots[cell]) ** 2).sum(1))
        bounds = np.concatenate([a + reach + np.array(near) for a, near in zip(apart, data["near"], strict=True)])
        order = np.argsort(bounds, kind="stable")
        bounds = bounds[order][np.sort(np.unique(ids[order], return_index=True)[1])]
        kth = bounds[k - 1] if len(bounds) >= k else np.inf
        out[int(cell)] = (kth + reach) * (1 + 1e-9) + 1e-6
    return out


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products.

    ``queries`` are rows of the same form; a query meets every row but those with
    its own id; ties go to the smaller vec_id.  Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part; a shorter vector
    counts as ending in zeros; repeated rows count each; other columns are ignored;
    empty tables give no rows.
    """
    spark = embeddings.sparkSession
    data, asked = written(quantised(embeddings), "data"), written(quantised(queries), "queries")
    traits = data.agg(F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.count("*")).first()
    own = asked.agg(F.max(F.size("vector")), F.count("*")).first()
    if not traits[2] or not own[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top, rows = max(traits[0], own[0]), float(traits[1]), int(traits[2])
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).toPandas()
    points = matrix(sample["vector"], width)
    points = np.concatenate([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))[:, None]], axis=1)
    centre = centres(points, pivots)
    cells, asked_cells = _summaries(data, centre, width, top, k + 1), _summaries(asked, centre, width, None, k + 1)
    reach = radii(centre, asked_cells, cells, k + 1)

    # neighbouring query cells share a group, so that data near several goes there once
    groups = max(1, min(len(reach), -(-int(own[1]) // QUERY_BLOCK)))
    order = sorted(reach, key=lambda c: tuple(centre[c][:2]))
    group = {c: n * groups // len(order) for n, c in enumerate(order)}
    sizes = np.zeros(groups, np.int64)
    for cell, size in zip(asked_cells["cell"], asked_cells["size"], strict=True):
        sizes[group[int(cell)]] += size
    query_blocks = [int(max(1, -(-s // QUERY_BLOCK))) for s in sizes]
    data_blocks = max(1, -(-rows // DATA_BLOCK))
    some = np.array(order)

    def send(batches):
        """Each data row to the groups with a cell in whose radius it lies, for every block of queries there."""
        for batch in batches:
            vectors = matrix(batch.column("vector"), width)
            away = _distances(vectors, np.sqrt(np.maximum(top - (vectors**2).sum(1), 0)), centre[some])
            inside = away <= np.array([reach[int(c)] for c in some])
            places = [np.flatnonzero(inside[:, [group[int(c)] == g for c in some]].any(1)) for g in range(groups)]
            for g, place in enumerate(places):
                kept = batch.take(pa.array(place))
                for block in range(query_blocks[g]):
                    count = kept.num_rows
                    yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("vector"), pa.array(np.full(count, g)), pa.array(np.full(count, block))], ["vec_id", "vector", "group", "query_block"])

    def place(batches):
        for batch in batches:
            vectors = matrix(batch.column("vector"), width)
            cell = some[_distances(vectors, np.zeros(len(vectors)), centre[some]).argmin(1)] if len(vectors) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(np.array([group[int(c)] for c in cell], np.int64))], ["vec_id", "vector", "group"])

    sent = data.mapInArrow(send, "vec_id long, vector array<double>, group long, query_block long")
    sent = sent.withColumn("data_block", F.pmod(F.xxhash64("vec_id"), F.lit(data_blocks)))
    blocks = F.element_at(F.array(*(F.lit(b) for b in query_blocks)), (F.col("group") + 1).cast("int"))
    asked = asked.mapInArrow(place, "vec_id long, vector array<double>, group long")
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks).cast("long"))
    asked = asked.withColumn("data_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(data_blocks - 1).cast("long"))))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy()
            a, b = matrix(left["vector"], width), matrix(right["vector"], width)
            exact = np.abs(a).max() * np.abs(b).max() * width < 2**53
            score = (a @ b.T) if exact else a.astype(np.int64) @ b.astype(np.int64).T
            score = score.astype(np.int64)
            low = np.iinfo(np.int64).min
            for query, row in zip(left["vec_id"], score, strict=True):
                row[ids == query] = low
                least = np.partition(row, -k)[-k] if len(row) > k else low
                best = np.flatnonzero((row >= least) & (row > low))
                best = best[np.lexsort((ids[best], -row[best]))][:k]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += row[best].tolist()
        return pd.DataFrame(out).astype("int64")

    keys = ["group", "query_block", "data_block"]
    local = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
