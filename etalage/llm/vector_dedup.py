"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the nearest few of some centres; each of these overlapping shards
builds a graph whose neighbour lists are pruned robustly, the lists of a vector's
shards are united, and every vector searches from a medoid, best first, then on
through all it finds in range.  What it finds is verified in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etalage.llm.common import components, written
from etalage.llm.vectors import centres, matrix, is_usable, usable

COSINE = 0.95
SHARD_ROWS = 1_024
MAX_CENTRES = 2_048
#: Rows that the centres are fitted on, at most.
MAX_SAMPLE = 16_384
OVERLAP = 3
#: A shard with more members is cut into blocks of about so many, which all meet.
BLOCK_ROWS = 4_096
DEGREE = 24
NEAREST, RANDOM = 40, 24
ALPHA = 1.2
BEAM = 24

_FOUND = "kind int, a long, b long, n long"


def build_graph(points: np.ndarray, seed: int) -> np.ndarray:
    """Neighbour lists (rows of places, -1 where there is none) of unit vectors."""
    count = len(points)
    if count < 2:
        return np.full((count, 1), -1)
    like = points @ points.T
    np.fill_diagonal(like, -2)
    near = min(NEAREST, count - 1)
    candidates = np.argpartition(-like, near - 1, axis=1)[:, :near]
    far = np.random.RandomState(seed).randint(0, count, (count, min(RANDOM, count)))
    candidates = np.concatenate([candidates, far], axis=1)
    own = np.take_along_axis(like, candidates, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    np.fill_diagonal(like, 1)
    alive = own > -2
    chosen = np.zeros_like(alive)
    for k in range(candidates.shape[1]):
        pick = alive[:, k] & (chosen.sum(1) < DEGREE)
        chosen[:, k] = pick
        between = like[candidates[:, k, None], candidates]
        covered = ALPHA**2 * (2 - 2 * between) <= 2 - 2 * own
        alive &= ~(covered & pick[:, None])
    lists = np.where(chosen, candidates, -1)
    back: list[list[int]] = [[] for _ in range(count)]
    for row, place in zip(*np.nonzero(chosen), strict=True):
        target = candidates[row, place]
        if len(back[target]) < DEGREE:
            back[target].append(row)
    reverse = np.full((count, DEGREE), -1)
    for row, some in enumerate(back):
        reverse[row, : len(some)] = some
    return np.concatenate([lists, reverse], axis=1)


def search_range(points: np.ndarray, lists: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) pairs found at a likeness of ``least`` or more."""
    count = len(points)
    seen = np.full((len(queries), count), -2, np.float32)
    opened = np.zeros(seen.shape, bool)
    medoid = int((points @ points.mean(0)).argmax())
    seen[:, medoid] = queries @ points[medoid]
    least = np.float32(least - 1e-4)

    def visit(query: np.ndarray, place: np.ndarray) -> None:
        opened[query, place] = True
        target = lists[place]
        new = (target >= 0) & (seen[query[:, None], target] == -2)
        row, column = np.nonzero(new)
        target, row = target[row, column], query[row]
        for at in range(0, len(row), 200_000):
            q, t = row[at : at + 200_000], target[at : at + 200_000]
            seen[q, t] = np.einsum("ij,ij->i", queries[q], points[t])

    every = np.arange(len(queries))
    for _ in range(BEAM):  # best first
        ahead = np.where(opened, np.float32(-2), seen)
        best = ahead.argmax(1)
        some = ahead[every, best] > -2
        if not some.any():
            break
        visit(every[some], best[some])
    while True:  # then all in range
        query, place = np.nonzero((seen >= least) & ~opened)
        if not len(query):
            break
        for at in range(0, len(query), 20_000):
            visit(query[at : at + 20_000], place[at : at + 20_000])
    return np.nonzero(seen >= least)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same places with at most one per place."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append((x, y))
    return kept


def _shards(classes: DataFrame, width: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, vector, n, cell, own, block) of every member, and (cell, blocks) of every cell."""
    count = max(1, min(MAX_CENTRES, -(-rows // SHARD_ROWS)))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).select("vector").toPandas()
    points = matrix(sample["vector"], width)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centre = centres(points, count)
    overlap = min(OVERLAP, len(centre))

    def assign(batches):
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
            away = (centre**2).sum(1) - 2 * points @ centre.T
            best = np.argsort(away, axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "vector", "n")), pa.array(list(best.astype(np.int64)), pa.list_(pa.int64()))], ["id", "vector", "n", "cells"])

    assigned = classes.mapInArrow(assign, "id long, vector array<double>, n long, cells array<long>")
    members = written(assigned.select("id", "vector", "n", F.posexplode("cells").alias("place", "cell")), "members")
    # one row per centre, of which there are at most MAX_CENTRES
    sizes = members.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    return members.join(F.broadcast(sizes), "cell").select("id", "vector", "n", "cell", (F.col("place") == 0).alias("own"), "blocks", block.alias("block")), sizes


def vector_dedup(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors link when their cosine, in doubles, is at least ``cosine``; links
    are searched, so some may be missed (audit_recall measures how many), and none
    is below.  Equal vectors are one class in the search and all linked.  Vectors
    that are null, zero or hold null or non-finite components link with nothing; rows
    without an id take no part (null component, not kept); each row has a result of its
    own, also where rows share an id; a shorter vector counts as
    ending in zeros; repeated rows count each; other columns are ignored; an empty
    table gives no rows.
    """
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    linkable = is_usable() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    fine = base.where(linkable).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    fine = fine.withColumn("class", F.xxhash64("vector", F.lit(7)))
    classes = written(fine.groupBy("class").agg(F.min("vec_id").alias("id"), F.first("vector").alias("vector"), F.count("*").alias("n")), "vectors")
    traits = classes.agg(F.max(F.size("vector")), F.count("*")).first()

    def unlinked(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    if not traits[1]:
        return unlinked(base)
    width, rows = int(traits[0]), int(traits[1])
    shards, _ = _shards(classes, width, rows)
    shards = written(shards, "shards")

    def unit(vectors) -> np.ndarray:
        points = matrix(vectors, width)
        return points / np.linalg.norm(points, axis=1, keepdims=True)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids = part["id"].to_numpy()
        lists = build_graph(unit(part["vector"]).astype(np.float32), int(key[0]) % 1000)
        return pd.DataFrame({"id": ids, "near": [np.unique(ids[x[x >= 0]]) for x in lists]})

    lists = shards.select("id", "vector", "cell", "block").groupBy("cell", "block").applyInPandas(build, "id long, near array<long>")
    # at most OVERLAP lists of at most 2 * (NEAREST + RANDOM) neighbours each
    graph = written(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    data = shards.join(graph, "id").select("id", "vector", "n", "cell", "own", "near", F.col("block").alias("data_block"), every.alias("query_block"), F.lit(False).alias("asks"))
    asked = shards.where("own").select("id", "vector", "n", "cell", "own", F.array().cast("array<long>").alias("near"), every.alias("data_block"), F.col("block").alias("query_block"), F.lit(True).alias("asks"))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        there, here = part[~part["asks"]].sort_values("id"), part[part["asks"]].sort_values("id")
        out: list[tuple[int, int, int, int]] = []
        if len(there) and len(here):
            ids, own, weight = there["id"].to_numpy(), there["own"].to_numpy(), there["n"].to_numpy()
            points, queries = unit(there["vector"]), unit(here["vector"])
            place = pd.Index(ids)
            lists = [p[p >= 0] for p in (place.get_indexer(x) for x in there["near"])]
            longest = max(1, max(len(x) for x in lists))
            padded = np.full((len(ids), longest), -1)
            for k, some in enumerate(lists):
                padded[k, : len(some)] = some
            asks = here["id"].to_numpy()
            for at in range(0, len(asks), SHARD_ROWS):  # bounds the tables of the search
                q, t = search_range(points.astype(np.float32), padded, queries[at : at + SHARD_ROWS].astype(np.float32), cosine)
                q = q + at
                real = (asks[q] != ids[t]) & (np.einsum("ij,ij->i", queries[q], points[t]) >= cosine)
                q, t = q[real], t[real]
                inside = own[t] if key[1] == key[2] else np.zeros(len(t), bool)
                out += [(2, min(a, b), max(a, b), 0) for a, b in zip(asks[q[~inside]].tolist(), ids[t[~inside]].tolist(), strict=True)]
                out += [(0, a, b, 0) for a, b in zip(asks[q[inside]].tolist(), ids[t[inside]].tolist(), strict=True)]
            inner = np.array([(a, b) for kind, a, b, _ in out if kind == 0], np.int64).reshape(-1, 2)
            out = [x for x in out if x[0] == 2]
            if len(inner):  # pairs that only this task can find: counted here, both ways
                inner = np.unique(np.concatenate([inner, inner[:, ::-1]]), axis=0)
                counts = pd.Series(weight[place.get_indexer(inner[:, 1])]).groupby(inner[:, 0]).sum()
                out += [(0, int(a), 0, int(n)) for a, n in counts.items()]
                out += [(1, a, b, 0) for a, b in _forest(inner[:, 0], inner[:, 1])]
        return pd.DataFrame(out, columns=["kind", "a", "b", "n"]).astype({"kind": "int32", "a": "int64", "b": "int64", "n": "int64"})

    found = written(data.unionByName(asked).groupBy("cell", "query_block", "data_block").applyInPandas(search, _FOUND).distinct(), "found")
    pairs = found.where("kind = 2").select("a", "b")
    sizes = classes.select("id", "n")
    both = pairs.union(pairs.select(F.col("b"), F.col("a"))).withColumnRenamed("a", "from").join(sizes.select(F.col("id").alias("b"), "n"), "b")
    links = found.where("kind = 0").select(F.col("a").alias("id"), "n").union(both.select(F.col("from").alias("id"), "n")).groupBy("id").agg(F.sum("n").alias("links"))
    joined = components(found.where("kind > 0").select("a", "b")).withColumnRenamed("node", "id")
    named = classes.select("class", "id", "n").join(links, "id", "left").join(joined, "id", "left")
    named = written(named.select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")), "named")
    keyed = fine.select("vec_id", "class").join(named, "class")
    linked = keyed.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    return linked.union(unlinked(base.where(~linkable)))


def audit_recall(embeddings: DataFrame, result: DataFrame, cosine: float = COSINE, every: int = 20) -> tuple[int, int]:
    """(links found, links there) of the vectors whose id is divisible by ``every``, by brute force.

    The queries meet all rows in blocks; only counts come back.
    """
    asked = usable(embeddings.where(F.col("vec_id") % every == 0)).select("vec_id", "embedding")
    width = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 1
    blocks = max(1, -(-asked.count() // 1_024))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    data = usable(embeddings).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (F.xxhash64("vec_id") % 16).alias("part"))
    asked = asked.withColumn("part", F.explode(F.array(*(F.lit(k).cast("long") for k in range(-15, 16)))))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []}).astype("int64")
        a, b = matrix(left["embedding"], width), matrix(right["embedding"], width)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        near = (a @ b.T >= cosine) & (left["vec_id"].to_numpy()[:, None] != right["vec_id"].to_numpy())
        return pd.DataFrame({"vec_id": left["vec_id"].to_numpy(), "n": near.sum(1)}).astype("int64")

    there = asked.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    sums = there.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return int(sums[0] or 0), int(sums[1] or 0)
