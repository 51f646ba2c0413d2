"""Mixing sources to target weights, in DataFrame operations only.

A source's blocks are the subtasks of a task with its weight: block i of weight w,
counted from 0, is released at floor(i / w) and due by ceil((i + 1) / w).

Weights are exact fractions.  The two lightest sources (or groups) share the slots
of a group of their joint weight, evenly by rounding, and so on up to all slots: a
block finds its slot from its number and the weights on its path, in whole numbers,
however long the mixture is.  Rounding adds up along a path, to less than 1.7 blocks,
as the weights on it grow like Fibonacci's numbers.

With a given period the schedule is Pfair: weights are whole parts of the period,
at least one each, which is scheduled earliest deadline first and repeated.
"""

from __future__ import annotations

import heapq
import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import checked_broadcast, written

BLOCK_ROWS = 16
#: Rows of a source that are numbered by one task.
BUCKET_ROWS = 20_000
#: Target weight of a source that is given none: its rows to this power.
TEMPERATURE = 0.7


def whole_weights(sizes: DataFrame, weights: dict[str | None, float] | None, period: int) -> DataFrame:
    """(source, size, parts): parts of the period, at least one each, that sum to it.

    Largest remainders decide, ties by source.  Sources have to be at most as many as parts.
    """
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), TEMPERATURE)
    else:
        wanted = F.lit(None).cast("double")
        for name, weight in weights.items():
            wanted = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(wanted)
        wanted = F.greatest(F.coalesce(wanted, F.lit(0.0)), F.lit(1e-9))
    every = Window.partitionBy()
    ordered = Window.orderBy(F.desc("rest"), F.asc_nulls_first("source"))
    free = F.lit(period) - F.count("*").over(every)  # one part each is set
    exact = free * F.col("wanted") / F.sum("wanted").over(every)
    return (
        sizes.withColumn("wanted", wanted)
        .withColumn("exact", exact)
        .withColumn("rest", F.col("exact") - F.floor("exact"))
        .withColumn("spare", free - F.sum(F.floor("exact")).over(every))
        .select("source", "size", (1 + F.floor("exact") + F.when(F.row_number().over(ordered) <= F.col("spare"), 1).otherwise(0)).cast("long").alias("parts"))
    )


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def schedule(weights: DataFrame, period: int) -> DataFrame:
    """(source, turn, slot): the slot of each block of a period, earliest deadline first.

    ``weights``: (source, parts), at most ``period`` rows; they are folded slot by
    slot in one expression over the array of sources.
    """
    rows = weights.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("known"), "source", "parts"))).alias("all"))
    start = F.struct(F.transform("all", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        # of the blocks that are released, the one with the earliest deadline, then the first source
        def key(x: Column, i: Column) -> Column:
            done = F.get(state["done"], i)
            released = F.floor(done * period / x["parts"]) <= slot
            left = released & (done < x["parts"])
            return F.when(left, F.struct(_ceil_div((done + 1) * period, x["parts"]).alias("deadline"), i.alias("i")))

        pick = F.array_min(F.transform("all", key))["i"]
        done = F.transform(state["done"], lambda d, i: d + F.when(i == pick, 1).otherwise(0))
        return F.struct(done.alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    order = rows.select("all", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step)["order"].alias("order"))
    slots = order.select("all", F.posexplode("order").alias("slot", "i")).select(F.get("all", F.col("i"))["source"].alias("source"), F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1
    return slots.withColumn("turn", turn)


def exact_weights(sizes: dict[str | None, int], weights: dict[str | None, float] | None) -> dict[str | None, int]:
    """Whole numbers in exactly the ratio of the weights, which are decimals as they are printed.

    A source that is not in ``weights`` has weight 0.
    """
    if weights is None:
        exact = {s: Fraction(Decimal(repr(float(n) ** TEMPERATURE))) for s, n in sizes.items()}
    else:
        exact = {s: max(Fraction(0), Fraction(Decimal(str(weights.get(s, 0))))) for s in sizes}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    most = math.gcd(*whole.values()) or 1
    return {s: w // most for s, w in whole.items()}


def paths(weights: dict[str | None, int]) -> dict[str | None, list[tuple[int, int, bool]]]:
    """For each source the steps from itself to all slots: own weight, the joint weight, whether it is the first of the two."""
    order = sorted(weights, key=lambda s: (s is not None, s or ""))
    heap = [(weights[s], n) for n, s in enumerate(order) if weights[s]]
    heapq.heapify(heap)
    up, count = {}, len(order)
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        up[left], up[right] = (a, a + b, True, count), (b, a + b, False, count)
        heapq.heappush(heap, (a + b, count))
        count += 1
    out = {}
    for n, source in enumerate(order):
        steps = []
        while n in up:
            own, whole, first, n = up[n]
            steps.append((own, whole, first))
        out[source] = steps
    return out


def _exact_turns(spark, sizes: dict[str | None, int], weights: dict[str | None, int]) -> DataFrame:
    """(_p, own, whole, behind, path): weight, sum of weights, first slot of a source without weight, steps."""
    along, whole = paths(weights), sum(weights.values())

    def last(source):
        slot = sizes[source] - 1
        for own, joint, first in along[source]:
            slot = -((-(2 * slot + 1) * joint) // (2 * own)) - 1 if first else (2 * slot + 1) * joint // (2 * own)
        return slot

    behind = max((last(s) + 1 for s in sizes if weights[s]), default=0)
    rows = []
    for source in sorted(sizes, key=lambda s: (s is not None, s or "")):
        rows.append((source, Decimal(weights[source]), Decimal(whole), behind, [(Decimal(a), Decimal(b), c) for a, b, c in along[source]]))
        behind += 0 if weights[source] else sizes[source]
    kinds = "_p string, own decimal(38,0), whole decimal(38,0), behind long, path array<struct<own: decimal(38,0), joint: decimal(38,0), first: boolean>>"
    return written(spark.createDataFrame(rows, kinds), "weights")


def _exactly_placed(ranked: DataFrame, sizes: dict[str | None, int], weights: dict[str | None, int], block_rows: int) -> DataFrame:
    """``ranked`` with block, slot, release, deadline and place by exact weights."""
    turns = _exact_turns(ranked.sparkSession, sizes, weights)
    deep = turns.agg(F.max(F.size("path"))).first()[0] or 0
    step = "case when x.first then ((2 * n + 1) * x.joint) div (2 * x.own) - (case when ((2 * n + 1) * x.joint) % (2 * x.own) = 0 then 1 else 0 end) else ((2 * n + 1) * x.joint) div (2 * x.own) end"
    slot = F.expr(f"case when own > 0 then aggregate(path, block, (n, x) -> cast({step} as bigint)) else behind + block end")
    keyed = ranked.join(checked_broadcast(turns, 64 + 48 * deep), F.col("_source").eqNullSafe(F.col("_p")))
    keyed = keyed.withColumn("block", F.floor(F.col("_rank") / block_rows)).withColumn("slot", slot)
    keyed = keyed.withColumn("release", F.expr("case when own > 0 then (block * whole) div own end"))
    keyed = keyed.withColumn("deadline", F.expr("case when own > 0 then ((block + 1) * whole + own - 1) div own end"))
    return keyed.withColumn("place", F.col("_rank") % block_rows).drop("_p", "own", "whole", "behind", "path", "_rank")


def _numbered(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """``docs`` with _rank, from 0 within its source, in the order of a hash of the id.

    Rows are dealt to buckets by that hash; each task numbers one bucket of one
    source, and sums over bucket sizes give where it begins.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    dealt = docs.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_salt"), F.lit(buckets)))
    sizes = written(dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_size")), "buckets")
    before = F.sum("_size").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_size")
    base = sizes.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy(F.xxhash64("_id", "_salt"), "_id", "_salt")) - 1
    placed = dealt.withColumn("_own", own)
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    return placed.join(checked_broadcast(base, 40), same).withColumn("_rank", F.col("_base") + F.col("_own")).drop("_s", "_b", "_base", "_own", "_bucket")


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, period: int | None, bucket_rows: int) -> DataFrame:
    """``docs`` (_id, _source, _salt, ...) with block, slot, release, deadline, place."""
    counted = docs.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("rows"))
    sizes = counted.withColumn("size", _ceil_div(F.col("rows"), F.lit(block_rows)))
    if period is None:
        # one number per source is what the weights are made of
        known = {r.source: int(r.size) for r in sizes.select("source", "size").collect()}
        return _exactly_placed(_numbered(docs, bucket_rows), known, exact_weights(known, weights), block_rows)
    parts = written(whole_weights(sizes.select("source", "size"), weights, period), "weights")
    turns = written(schedule(parts.select("source", "parts"), period), "schedule")
    turns = turns.join(parts, turns.source.eqNullSafe(parts.source)).select(turns.source.alias("_s"), F.col("turn").alias("_t"), "slot", "parts")
    rank = F.col("_rank")
    block = F.floor(rank / block_rows)
    ranked = _numbered(docs, bucket_rows)
    # a source's blocks repeat its turns: turn block % parts of cycle block / parts
    keyed = ranked.join(F.broadcast(parts.select(F.col("source").alias("_p"), "parts")), F.col("_source").eqNullSafe(F.col("_p")))
    keyed = keyed.withColumn("block", block).withColumn("cycle", F.floor(block / F.col("parts"))).withColumn("turn", block % F.col("parts")).drop("_p", "parts")
    return (
        keyed.join(F.broadcast(turns), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("turn") == F.col("_t")))
        .withColumn("slot", F.col("cycle") * period + F.col("slot"))
        .withColumn("release", F.floor(F.col("block") * period / F.col("parts")))
        .withColumn("deadline", _ceil_div((F.col("block") + 1) * period, F.col("parts")))
        .withColumn("place", rank % block_rows)
        .drop("_s", "_t", "_rank", "turn", "cycle", "parts")
    )


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source): doc_id, source, block, slot, place, release, deadline.

    The mixture is the order of (slot, place).  A source's rows are cut into blocks
    of ``block_rows``; at every slot each source that still has rows has had less
    than 1.7 blocks more or less than its exact weight's share of the slots (with a
    ``period`` less than one, of weights rounded to parts of it).  Slots of a source
    that has run out stay empty, so the others keep their proportions and every row
    is in the mixture once.  ``weights`` gives target weights by source, any number
    of them; without it a source weighs its blocks to the power of TEMPERATURE.
    Sources of weight 0 follow behind all others, without release and deadline.

    A null source is a source of its own; null ids and repeated rows are placed as
    they are; an empty table gives no rows; more sources than a given ``period``
    raise an error, as no part is left for some.
    """
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), F.xxhash64(text).alias("_salt"))
    _enough(base, period)
    mixed = _mixed(base, weights, block_rows, period, bucket_rows)
    return mixed.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "block", "slot", "place", "release", "deadline")


def _enough(docs: DataFrame, period: int | None) -> None:
    if period is None:
        return
    sources = docs.select(F.count_distinct(F.coalesce("_source", F.lit("\0")))).first()[0]
    if sources > period:
        raise ValueError(f"{sources} sources do not fit into a period of {period} slots")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``docs``, with their own columns, range-partitioned and sorted into the mixture."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), F.xxhash64(F.col("text").cast("string")).alias("_salt"), F.struct(*fields).alias("_row"))
    _enough(base, period)
    mixed = _mixed(base, weights, block_rows, period, bucket_rows)
    return mixed.repartitionByRange("slot", "place", "_id").sortWithinPartitions("slot", "place", "_id").select("_row.*")
