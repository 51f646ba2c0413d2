"""Shared helpers: written intermediates, checked broadcasts, word hashes, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etalage.session import shared_folder

#: A side is broadcast only when its counted rows stay below this many bytes.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000
#: Texts are hashed in pieces of about this many bytes, whole documents each.
CHUNK_BYTES = 1 << 19


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more, to free the shared folder."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose tables nobody holds any more.

    It does so when the driver collects its garbage, by default every half hour: too late for a chain of many steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow carry at most BATCH_ROWS rows at a time to Python, as whole texts are long.

    A session that set a number of its own keeps it.
    """
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(BATCH_ROWS))


def checked_broadcast(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A hint to broadcast, given only if the counted size allows it; else Spark shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; one longer document stays in one piece."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


_RANDOM = np.random.RandomState(20240229)
_BYTE = _RANDOM.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, size: int) -> np.ndarray:
    if len(_powers.get(name, ())) < size:
        steps = np.full(max(size, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some rows, A-Z taken as a-z, with 64-bit hashes.

    ``start``, ``end``: byte places; ``row``: the row of each word; ``first``: the
    place of each row's first word, with one more entry at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        letter = ~_SPACE[data]
        before = np.zeros(size, bool)
        before[1:] = letter[:-1]
        after = np.zeros(size, bool)
        after[:-1] = letter[1:]
        self.start = np.flatnonzero(letter & (~before | edge[:size]))
        self.end = np.flatnonzero(letter & (~after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, "up", size), out=self._sums[1:]) if size else None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hashes of byte ranges (of the words, unless given): equal bytes, equal hash."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        down = _power(_INVERSE, "down", len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def shingles(self, words: int) -> list[np.ndarray]:
        """For each row its distinct shingles of ``words`` words as sorted 64-bit hashes.

        A row with fewer words gives its whole sequence as one; a row without words, none.
        """
        hashed = self.hashes()
        factor = 1
        count = len(hashed)
        total = np.zeros(max(0, count - words + 1), np.uint64)
        for place in range(words):
            factor = (factor * int(_BASE) + 2 * place) % 2**64
            total += hashed[place : place + len(total)] * np.uint64(factor)
        total = mix(total + np.uint64(words))
        found = []
        for begin, stop in zip(self.first[:-1], self.first[1:], strict=True):
            if stop - begin >= words:
                found.append(np.unique(total[begin : stop - words + 1]))
            elif stop > begin:
                some = mix(np.cumprod(np.full(stop - begin, _BASE, np.uint64)) * hashed[begin:stop])
                found.append(mix(some.sum(dtype=np.uint64, keepdims=True) + np.uint64(stop - begin)))
            else:
                found.append(np.zeros(0, np.uint64))
        return found


def word_chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a whole batch, piece by piece."""
    data, offsets = utf8(column)
    for row, end in chunks(offsets):
        part = offsets[row : end + 1]
        yield row, end, Words(data[part[0] : part[-1]], part - part[0])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u > v")
        .distinct()
    )
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(low, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node it reaches.

    Alternates large-star and small-star steps, each written to the shared folder,
    until the edges stay the same; the number of rounds grows with the logarithm
    of the longest path.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = written(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        before, now = now, written(_stars(now), "links")
        dropped(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
