"""Incremental history with Structured Streaming.

Files of listings arrive in any order, late and repeated.  Each micro-batch is cleaned, merged into the
months it touches, and published as a new version of the history; the other months keep
their files.  The table is the state: the stream itself keeps none, whatever its length, and a row that
arrives late still replaces the one it should.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage import vocab
from etalage.plans import cleaning, kpi
from etalage.session import shared_folder
from etalage.sources import retail_star as star
from etalage.sources.snapshots import with_lineage
from etalage.sources.versions import drop_versions, exists, publish, read_manifest, staging_folder

KEYS = ["magasin_standardise", "jour", "cle_matching_exacte", "prix", "source_file"]
#: What a version holds of each month: the cleaned rows, the history, and the states of the indicators.
KINDS = ("rows", "history", "values", "panel")
#: Raw columns that decide which of a day's repeated listings stays.
ORDER = ("magasin", "categorie")


def _month() -> Column:
    return F.date_format("jour", "yyyy-MM").alias("_mois")


def cleaned_rows(raw: DataFrame) -> DataFrame:
    """Analytics rows with the columns that decide between repeated listings, each by the month it belongs to."""
    return cleaning.daily_rows(raw).select(*vocab.ANALYTICS_COLUMNS, *ORDER, _month())


def _read(spark: SparkSession, root: str, kind: str, parts: dict[str, str]) -> DataFrame | None:
    """The given months of one kind of rows, each from the version that wrote it."""
    folders = [f"{root}/{folder}/{kind}/_mois={month}" for month, folder in sorted(parts.items())]
    return spark.read.parquet(*folders) if folders else None


def _months(rows: DataFrame) -> list[str]:
    return [r[0] for r in rows.select("_mois").distinct().collect()]  # one per month


def merge_batch(root: str, batch: DataFrame, batch_id: int) -> None:
    """Merge one micro-batch of raw listings and publish the version with it.

    Daily repeats are decided over old and new rows together, so the outcome does not depend on how
    listings were dealt to files.  Of a repeated batch nothing is done: its id is in the manifest.
    A month's price counts and its daily panel depend on that month's history alone: they are made anew for
    the touched months and kept for the others.
    """
    spark = batch.sparkSession
    current: dict[str, Any] = read_manifest(spark, root) or {"batch": -1, **{kind: {} for kind in KINDS}}
    if batch_id <= current["batch"]:
        return
    parts: dict[str, dict[str, str]] = {kind: dict(current[kind]) for kind in KINDS}
    cleaned, folder = cleaned_rows(batch), staging_folder(root)
    name = folder.rsplit("/", 1)[1]
    names = [c for c in cleaned.columns if c != "_mois"]
    if not parts["rows"]:  # nothing to merge with: the rows go to their months at once
        cleaned.write.partitionBy("_mois").parquet(f"{folder}/rows")
        touched = _months(spark.read.schema(cleaned.schema).parquet(f"{folder}/rows"))
    else:
        scratch = shared_folder(spark, "batch")
        cleaned.write.parquet(scratch)
        fresh = spark.read.schema(cleaned.schema).parquet(scratch)
        touched = _months(fresh)
        known = _read(spark, root, "rows", {m: parts["rows"][m] for m in touched if m in parts["rows"]})
        if known is not None:  # a batch has no daily repeats of its own left
            fresh = cleaning.dedup_daily(fresh.drop("_mois").unionByName(known)).withColumn("_mois", _month())
        if touched:
            fresh.write.partitionBy("_mois").parquet(f"{folder}/rows")
    if touched:
        rows = spark.read.schema(cleaned.select(*names).schema).parquet(*[f"{folder}/rows/_mois={m}" for m in touched]).drop(*ORDER)
        history = kpi.prepare_history(with_lineage(rows))
        history.select("*", _month()).write.partitionBy("_mois").parquet(f"{folder}/history")
        written = [m for m in touched if exists(spark, f"{folder}/history/_mois={m}")]
        prices = kpi.reliable_prices(_read(spark, root, "history", dict.fromkeys(written, name))) if written else None
        states = {"values": kpi.price_counts, "panel": kpi.daily_panel} if written else {}
        for kind, state in states.items():
            state(prices).select("*", F.col("mois").alias("_mois")).write.partitionBy("_mois").parquet(f"{folder}/{kind}")
        for kind in parts:  # a month of unusable rows only has no history
            there = [m for m in touched if exists(spark, f"{folder}/{kind}/_mois={m}")]
            parts[kind] |= dict.fromkeys(there, name)
    publish(spark, root, {"batch": batch_id, **parts})
    drop_versions(spark, root)


def run_available(stream: DataFrame, root: str, merge: Callable[[str, DataFrame, int], None] = merge_batch) -> list[dict]:
    """Ingest the files that are there now and stop; returns the progress of each micro-batch.

    The checkpoint lies beside the table: the next run goes on from it, and a batch that was lost on the
    way is repeated without doubling rows.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: merge(root, batch, batch_id))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query.recentProgress


def stored(spark: SparkSession, root: str, kind: str = "history") -> DataFrame | None:
    """One kind of rows of the current version; None as long as there are none."""
    current = read_manifest(spark, root)
    return _read(spark, root, kind, current[kind]) if current else None


def stored_history(spark: SparkSession, root: str) -> DataFrame | None:
    return stored(spark, root)


def _ingested(spark: SparkSession, sf_dir: str, kind: str = "history") -> DataFrame:
    """What is stored after a stream of files of listings."""
    folder = sf_dir.rstrip("/")
    schema = star.table(spark, folder, "lineitem").schema
    lines = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(folder)
    )
    root = shared_folder(spark, "stream")
    run_available(star.as_listings(spark, folder, lines), root)
    return stored(spark, root, kind)


def incremental_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings ingested as a stream of files: the history's keys."""
    return _ingested(spark, sf_dir).select(*KEYS)


def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings ingested as a stream of files: the whole rows of the history."""
    return _ingested(spark, sf_dir)


def incremental_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel as it is kept beside the history."""
    return kpi.daily_panel_rounded(_ingested(spark, sf_dir, "panel"))


def incremental_index(spark: SparkSession, sf_dir: str, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A monthly index from the price counts that are kept beside the history."""
    return index(_ingested(spark, sf_dir, "values"))
