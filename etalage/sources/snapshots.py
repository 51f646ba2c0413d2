"""Dated snapshots: schema-checked reading, the latest one, and the history of all.

Each shop delivers one snapshot a day.  Snapshots live as Parquet, partitioned
by date, or as one delimited text file each.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage import vocab
from etalage.operators.dedupe import keep_first


def required_columns(df: DataFrame | None, required: Sequence[str]) -> DataFrame | None:
    """Only the required columns, or None when one of them is missing."""
    if df is None or any(c not in df.columns for c in required):
        return None
    return df.select(*required)


def _read_text(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """Delimited text with a header, every column as text, missing-value spellings as null."""
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    blank = {c: F.when(~F.col(f"`{c}`").isin(*vocab.NA_TEXTS), F.col(f"`{c}`")) for c in df.columns}
    first = df.columns[0]
    return df.withColumns(blank).withColumnRenamed(first, first.lstrip("\ufeff"))


def read_source(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = vocab.RAW_COLUMNS,
    fmt: str = "parquet",
    multi_line: bool = False,
) -> DataFrame | None:
    """A source with the required columns, or None when it lacks one.

    Text formats are read as text, with the usual missing-value spellings as
    null; numbers and dates are coerced by the cleaning step.  ``multi_line`` is
    for texts that hold line breaks; such a file cannot be split among tasks.
    """
    if fmt == "csv":
        return required_columns(_read_text(spark, path, multi_line), required)
    return required_columns(spark.read.format(fmt).load(path), required)


def latest_snapshot(df: DataFrame, source: str, snapshot: str) -> DataFrame:
    """Rows of each source's newest snapshot.

    The newest date per source is a map-side aggregate of a few rows.
    """
    newest = df.groupBy(source).agg(F.max(snapshot).alias(snapshot))
    return df.join(newest, [source, snapshot], "left_semi")


def latest_path(spark: SparkSession, pattern: str) -> str | None:
    """The match of a path pattern that was written last, from the file listing alone.

    A match is one snapshot, a file or a folder of part files; unfinished ones,
    which carry ``_progress`` in their own name, are left out.
    """
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for match in files.globStatus(glob) or ():
        name = match.getPath().getName()
        if name.startswith(("_", ".")) or "_progress" in name:
            continue
        parts = files.listStatus(match.getPath()) if match.isDirectory() else [match]
        times = [part.getModificationTime() for part in parts]
        if times:
            found.append((max(times), match.getPath().toString()))
    return max(found)[1] if found else None


def latest_files(spark: SparkSession, *patterns: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the newest snapshot of each pattern, say one pattern for each shop."""
    newest = [path for path in (latest_path(spark, p) for p in patterns) if path]
    if not newest:
        raise ValueError("no finished snapshot")
    read = [_read_text(spark, p, False) if fmt == "csv" else spark.read.format(fmt).load(p) for p in newest]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def with_lineage(analytics: DataFrame, prefix: str = "analytics_") -> DataFrame:
    """Name the snapshot each row came from, for tables that hold many."""
    return analytics.withColumn(
        "source_file", F.concat(F.lit(prefix), F.col("date_scraping").cast("string"))
    )


def history_union(snapshots: Iterable[DataFrame]) -> DataFrame:
    """All usable snapshots in one table; absent optional columns get their defaults.

    A snapshot that lacks a required column is skipped.
    """
    usable = [
        s for s in snapshots if all(c in s.columns for c in (*vocab.HISTORY_REQUIRED, "source_file"))
    ]
    if not usable:
        raise ValueError("no usable analytics snapshot")
    completed = []
    for s in usable:
        missing = {c: F.lit(v) for c, v in vocab.HISTORY_DEFAULTS.items() if c not in s.columns}
        if "score_matching" not in s.columns:
            missing["score_matching"] = F.lit(None).cast("bigint")
        completed.append(s.withColumns(missing) if missing else s)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), completed)


def _snapshot_name(path: Column) -> Column:
    """The ``snapshot=`` folder, else the folder of a part file, else the file's own name."""
    names = [F.regexp_extract(path, p, 1) for p in (r"/(snapshot=[^/]+)/", r"/([^/]+)/part-[^/]+$", r"([^/]+)$")]
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def read_history(
    spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """The history of the given snapshot paths, each row tagged with its snapshot's name.

    However many part files a snapshot has, its rows carry one name.  Snapshots
    with the same columns are read together, so the plan has one branch for each
    layout the shops have used, not one for each day.
    """
    layouts: dict[str, list[str]] = {}
    for path in paths:
        df = _read_text(spark, path, multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
        layouts.setdefault(df.schema.simpleString(), []).append(path)

    def tagged(group: list[str]) -> DataFrame:
        df = _read_text(spark, group, multi_line) if fmt == "csv" else spark.read.format(fmt).load(group)
        return df.select("*", _snapshot_name(F.col("_metadata.file_path")).alias("source_file"))

    return history_union(tagged(group) for group in layouts.values())


def dedup_listing(df: DataFrame) -> DataFrame:
    """First listing of each name, price and shop."""
    return keep_first(
        df, ["nom_produit", "prix", "magasin"], ["date_scraping", "categorie", "url_produit"]
    )


def merge_sources(sources: Iterable[DataFrame | None]) -> DataFrame:
    """The usable sources in one table, without repeats, in shop, category, name order."""
    usable = [s for s in sources if s is not None]
    if not usable:
        raise ValueError("no usable source")
    merged = reduce(DataFrame.unionByName, usable)
    return dedup_listing(merged).orderBy(
        F.col("magasin").asc_nulls_last(),
        F.col("categorie").asc_nulls_last(),
        F.col("nom_produit").asc_nulls_last(),
    )
