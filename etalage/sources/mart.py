"""The mart: one dataset per table and snapshot, and the check that all are there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage import vocab
from etalage.plans import kpi
from etalage.session import shared_folder
from etalage.sources.versions import exists, publish, read_manifest, staging_folder


#: Text settings under which every value that was written is read back.
_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.options(**(_TEXT if fmt == "csv" else {})).format(fmt).load(path)


def _counted(df: DataFrame) -> tuple[int, str]:
    """Rows of a dataset, and a digest that does not depend on their order."""
    hashed = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    rows, total = df.agg(F.count(F.lit(1)), hashed).first()
    return rows, str(total or 0)


def stage_table(df: DataFrame, folder: str, fmt: str = "parquet") -> dict[str, Any]:
    """Write a table to a staging folder; its entry in the manifest is taken from what was written."""
    df.write.options(**(_TEXT if fmt == "csv" else {})).format(fmt).save(folder)
    rows, digest = _counted(_read(df.sparkSession, folder, fmt))
    return {"path": folder, "format": fmt, "rows": rows, "digest": digest}


def write_mart(
    tables: Mapping[str, DataFrame], path: str, snapshot: str, fmt: str = "parquet"
) -> None:
    """Publish tables of a snapshot; the context also as JSON lines.

    All tables are staged in a new folder, then one manifest makes them, with the other tables of that and
    of earlier snapshots, the current mart.  A run that is lost before leaves the old mart as it was.
    """
    publish_tables(path, snapshot, stage_tables(tables, staging_folder(path), snapshot, fmt), tables)


def stage_tables(tables: Mapping[str, DataFrame], folder: str, snapshot: str, fmt: str = "parquet") -> dict[str, dict[str, Any]]:
    entries = {name: stage_table(df, f"{folder}/{name}/snapshot={snapshot}", fmt) for name, df in tables.items()}
    if "ai_context" in tables:
        entries["ai_context_json"] = stage_table(tables["ai_context"], f"{folder}/ai_context_json/snapshot={snapshot}", "json")
    return entries


def publish_tables(path: str, snapshot: str, entries: Mapping[str, dict[str, Any]], tables: Mapping[str, DataFrame]) -> None:
    """Switch to a mart with these entries; those of other names and snapshots stay."""
    spark = next(iter(tables.values())).sparkSession
    current = (read_manifest(spark, path) or {"snapshots": {}})["snapshots"]
    # paths are kept relative to the mart, so that it can be moved as a whole
    relative = {name: {**e, "path": e["path"].removeprefix(f"{path}/")} for name, e in entries.items()}
    publish(spark, path, {"snapshots": {**current, snapshot: {**current.get(snapshot, {}), **relative}}})


def mart_entries(spark: SparkSession, path: str, snapshot: str) -> dict[str, dict[str, Any]]:
    """The manifest of a snapshot: path, format, rows and digest of each dataset."""
    return (read_manifest(spark, path) or {"snapshots": {}})["snapshots"].get(snapshot, {})


def table_path(spark: SparkSession, path: str, name: str, snapshot: str) -> str:
    return f"{path}/{mart_entries(spark, path, snapshot)[name]['path']}"


def read_mart(spark: SparkSession, path: str, name: str, snapshot: str) -> DataFrame:
    """A published table in the format it was written in."""
    return _read(spark, table_path(spark, path, name, snapshot), mart_entries(spark, path, snapshot)[name]["format"])


def mart_manifest(
    spark: SparkSession,
    path: str,
    snapshot: str,
    expected: Sequence[str] = (*vocab.MART_TABLES, "ai_context_json"),
) -> DataFrame:
    """Rows per expected dataset, counted where it lies and in its own format; null for one that is not there."""
    entries = mart_entries(spark, path, snapshot)
    counts = []
    for name in expected:
        if name in entries and exists(spark, f"{path}/{entries[name]['path']}"):
            rows = read_mart(spark, path, name, snapshot).agg(F.count(F.lit(1)).alias("nb_lignes"))
        else:
            rows = spark.range(1).select(F.lit(None).cast("bigint").alias("nb_lignes"))
        counts.append(rows.select(F.lit(name).alias("jeu"), "nb_lignes"))
    return reduce(DataFrame.unionByName, counts)


def damaged_tables(spark: SparkSession, path: str, snapshot: str) -> list[str]:
    """The datasets whose rows or digest are no longer those of the manifest."""
    found = []
    for name, entry in sorted(mart_entries(spark, path, snapshot).items()):
        there = exists(spark, f"{path}/{entry['path']}")
        if not there or _counted(read_mart(spark, path, name, snapshot)) != (entry["rows"], entry["digest"]):
            found.append(name)
    return found


def check_mart(manifest: DataFrame) -> None:
    """Fail with the names of the missing datasets; the manifest has one row per table."""
    missing = [r.jeu for r in manifest.filter("nb_lignes IS NULL").orderBy("jeu").collect()]
    if missing:
        raise RuntimeError(f"missing mart datasets: {', '.join(missing)}")


def publish_mart(spark: SparkSession, history: DataFrame, path: str, snapshot: str, fmt: str = "parquet") -> None:
    """Write the whole mart of a history and publish it at once.

    The prepared history and every table that others build on are written once
    and read back, so no table repeats the work of another and a lost executor
    costs one stage, not the chain.  The copies go when the mart is complete.
    """
    work, folder = shared_folder(spark, "history"), staging_folder(path)
    entries: dict[str, dict[str, Any]] = {}

    def stored(name: str, df: DataFrame) -> DataFrame:
        """A table that others build on: with its types in the working folder, in the mart's format in the mart."""
        df.write.parquet(f"{work}/{name}")
        kept = spark.read.parquet(f"{work}/{name}")
        entries.update(stage_tables({name: kept}, folder, snapshot, fmt))
        return kept

    history.write.parquet(f"{work}/history")
    history = spark.read.parquet(f"{work}/history")
    prices = kpi.reliable_prices(history)
    kpi.price_counts(prices).write.parquet(f"{work}/values")
    values = spark.read.parquet(f"{work}/values")
    panel = stored("daily_panel", kpi.daily_panel(prices))
    competition = stored("competitiveness", kpi.competitiveness(panel))
    variation = stored("variation_index", kpi.variation_index(values))
    volatility = stored("fluctuation", kpi.fluctuation(prices))
    inflation = stored("inflation_global", kpi.inflation_global(values))
    score = stored("category_store_score", kpi.category_store_score(prices))
    rest = {
        "inflation_category": kpi.inflation_category(values),
        "ai_context": kpi.context_table(score),
        "summary": kpi.kpi_summary(prices, variation, competition, volatility, inflation),
        "quality": kpi.quality_report(history, panel),
    }
    entries.update(stage_tables(rest, folder, snapshot, fmt))
    publish_tables(path, snapshot, entries, rest)
    copy = spark._jvm.org.apache.hadoop.fs.Path(work)
    copy.getFileSystem(spark._jsc.hadoopConfiguration()).delete(copy, True)


def _publish(spark: SparkSession, tables: Any, fmt: str = "parquet") -> tuple[str, str]:
    path, snapshot = shared_folder(spark, "mart"), "latest"
    publish_mart(spark, tables.history, path, snapshot, fmt)
    return path, snapshot


def mart_written(spark: SparkSession, tables: Any) -> DataFrame:
    """Write the whole mart and read its competitiveness table back."""
    path, snapshot = _publish(spark, tables)
    return read_mart(spark, path, "competitiveness", snapshot)


def mart_checked(spark: SparkSession, tables: Any) -> DataFrame:
    """Write the whole mart, check it, and give the rows per dataset."""
    path, snapshot = _publish(spark, tables)
    manifest = mart_manifest(spark, path, snapshot)
    check_mart(manifest)
    return manifest


def text_mart_checked(spark: SparkSession, tables: Any) -> DataFrame:
    """The same for a mart of delimited text: nothing may be missing or differ from the manifest."""
    path, snapshot = _publish(spark, tables, "csv")
    manifest = mart_manifest(spark, path, snapshot)
    check_mart(manifest)
    if damaged := damaged_tables(spark, path, snapshot):
        raise RuntimeError(f"damaged mart datasets: {', '.join(damaged)}")
    return manifest
