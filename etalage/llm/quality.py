"""Quality by perplexity under an interpolated modified Kneser-Ney model of subword n-grams.

Texts are cut into pieces of words and single signs, without folding any letter.
The model holds the counts of every n-gram of the trusted texts, so it grows with
them: its tables stay sharded, and blocks of documents send their distinct n-grams
to the shards and get back the counts and context sums of those that are there.
Keys and counts travel as bytes of many n-grams at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage.llm.common import _power, checked_broadcast, chunks, dropped, mix, released, small_batches, utf8, written
from etalage.session import shared_folder

ORDER = 3
#: Text that is cut at once; its arrays fit the processor's cache.
PARSED_BYTES = 1 << 17
#: Runs of letters and digits are cut into pieces of about so many bytes, whole characters each.
PIECE_BYTES = 6
#: A document is kept up to this quantile of the held-out trusted texts of its language.
QUANTILE = 0.97
#: One in so many distinct trusted texts is held out of the counts.
HELD_OUT = 5
#: Text whose n-grams are looked up together, text that asks one shard in a round, trusted text to a shard (about).
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
MODEL_BYTES = 2 << 20
#: Shards that lie in one bucket of the model's table (about).
BUCKET_SHARDS = 2
#: Parts in which the documents are scored, one after the other, at every size.
ROUNDS = 8
#: Different n-grams that a task collects before it sends them.
BUNDLED = 800_000

_RANDOM = np.random.RandomState(20240301)
_BYTE, _PLACE = (_RANDOM.randint(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, ORDER))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLANK, _LETTER, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each piece, place of each row's first piece) of a column, some rows at a time.

    A piece is a sign, a line feed, or a part of a run of letters and digits; whether
    a blank or the text's start is before it belongs to it.  No hash is 0.
    """
    data, offsets = utf8(column)
    for row, end in chunks(offsets, PARSED_BYTES):
        part, edges = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        size = len(part)
        edge = np.zeros(size + 1, bool)
        edge[edges] = True
        kind = _KIND[part]
        before = np.zeros(size, np.uint8)
        before[1:] = kind[:-1]
        before[edge[:size]] = _BLANK
        begins = (kind != _LETTER) | (before != _LETTER)
        run = np.flatnonzero(begins).astype(np.int32)
        since = np.arange(size, dtype=np.int32) - np.repeat(run, np.diff(run, append=np.int32(size)))
        number, lead = since // PIECE_BYTES, ((part & 0xC0) != 0x80) | edge[:size]
        if lead.all():
            begins[1:] |= number[1:] != number[:-1]
            mark = np.flatnonzero(begins)
        else:
            place = np.flatnonzero(lead)
            number, new = number[place], begins[place]
            new[1:] |= number[1:] != number[:-1]
            mark = place[new]
        stop = np.append(mark[1:], size)
        some = kind[mark] != _BLANK
        start, stop = mark[some], stop[some]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power(_BASE, "up", size), out=sums[1:]) if size else None
        value = (sums[stop] - sums[start]) * _power(_INVERSE, "down", size + 1)[start]
        value = mix(value + (2 * (stop - start) + (before[start] == _BLANK)).astype(np.uint64)) | np.uint64(1)
        yield value, np.searchsorted(start, edges)


def _key(pieces: list[np.ndarray]) -> np.ndarray:
    """The key of n-grams, given the array of each place; the last piece is the last."""
    total = np.full(len(pieces[0]), len(pieces), np.uint64)
    for back, piece in enumerate(reversed(pieces)):
        total += piece * _PLACE[back]
    return mix(total)


def _grams(pieces: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The piece and the ORDER - 1 before it in its text, farthest first; 0 before the text."""
    age = np.arange(len(pieces)) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in range(ORDER - 1, -1, -1):
        moved = np.zeros_like(pieces)
        moved[k:] = pieces[: len(pieces) - k]
        back.append(np.where(age >= k, moved, np.uint64(0)))
    return back


def _chains(grams: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the 1-, 2-, ... grams that end at each piece, and of their contexts (none for the first)."""
    return [_key(grams[-n:]) for n in range(1, ORDER + 1)], [_key(grams[-n:-1]) for n in range(2, ORDER + 1)]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the bytes of their differences."""
    return keys[:1].tobytes() + _planes(np.diff(keys))


def _unpacked(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    steps = next(_from_planes(packed, 8)).view(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(packed, np.uint64, 1), steps]), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as how many they are, of how many bytes, and these with equal places together; places that are zero everywhere are left out."""
    if not len(values):
        return b""
    places = np.ascontiguousarray(values, np.uint64 if values.dtype == np.uint64 else np.int64).view(np.uint64)
    width = max(1, (int(places.max()).bit_length() + 7) // 8)
    return np.array([len(values) << 4 | width]).tobytes() + places.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(packed: bytes, at: int = 0) -> Iterator[np.ndarray]:
    """The rows of numbers that were put one after the other, from a byte on; without bytes there is one row of none."""
    if at == len(packed):
        yield np.zeros(0, np.int64)
    while at < len(packed):
        size, width = divmod(int(np.frombuffer(packed, np.int64, 1, at)[0]), 16)
        values = np.zeros((size, 8), np.uint8)
        values[:, :width] = np.frombuffer(packed, np.uint8, size * width, at + 8).reshape(width, size).T
        yield values.view(np.int64).ravel()
        at += 8 + size * width


def _from_planes_of(packed: bytes, width: int) -> np.ndarray:
    return np.stack(list(_from_planes(packed))) if packed else np.zeros((width, 0), np.int64)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Places at which another value begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, one place of each, and how often they are there."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = _runs(keys)
    return keys[begin], order[begin], np.diff(begin, append=len(keys))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their columns of ``values`` (one row a number)."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = _runs(keys)
    return keys[begin], np.add.reduceat(values[:, order], begin, axis=1) if len(keys) else values


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted keys and where each lies."""
    shard = _shard(keys, shards)
    begin = _runs(shard)
    for a, b in zip(begin, np.append(begin, len(keys))[1:], strict=True):
        yield int(shard[a]), slice(a, b)


def _bundle(grams: list[np.ndarray], n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Distinct n-grams and their numbers as the distinct pieces and the places of each n-gram's pieces among them."""
    words, place = np.unique(np.concatenate(grams), return_inverse=True)
    place = place.reshape(len(grams), -1)
    order = np.lexsort(place[[0, *range(len(grams) - 1, 0, -1)]])
    place = place[:, order]
    place[1] = np.diff(place[1], prepend=0)
    return _packed(words), b"".join(_planes(p.astype(np.int64)) for p in place), _planes(n[order].astype(np.int64))


def _unbundle(words: bytes, grams: bytes, n: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    place = list(_from_planes(grams))
    place[1] = np.cumsum(place[1])
    known = _unpacked(words)
    return [known[p] for p in place], next(_from_planes(n))


_COUNTED = "kind string, shard long, level int, keys binary, values binary, n1 long, n2 long, n3 long, n4 long, total long, kinds long"


def _table(rows: list[tuple]) -> pa.Table:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in _COUNTED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _counted(level: int, shard: int, keys: np.ndarray, n: np.ndarray) -> tuple:
    """The row of one shard's n-grams of a level, with what the discounts are made of."""
    return ("count", shard, level, _packed(keys), _planes(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int(n.sum()), len(n))


def _classes(n: np.ndarray) -> np.ndarray:
    """For each count: itself, and whether it is 1, 2, or more."""
    return np.stack([n, n == 1, n == 2, n > 2]).astype(np.int64)


def ngram_counts(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, words, grams, n): bundles of the distinct n-grams of order ORDER of some whole texts.

    An n-gram's shard is that of its last ORDER - 1 pieces, so all counts below come from one shard.
    """

    def bundles(held):
        grams = [np.concatenate(g) for g in zip(*(g for g, _ in held), strict=True)]
        key = _key(grams)
        order = np.argsort(key)
        begin = _runs(key[order])
        n = np.add.reduceat(np.concatenate([n for _, n in held])[order], begin)
        grams = [g[order[begin]] for g in grams]
        shard = _shard(_key(grams[1:]), shards)
        order = np.argsort(shard, kind="stable")
        begin = _runs(shard[order])
        for part in np.split(order, begin[1:]) if len(order) else []:
            yield int(shard[part[0]]), *_bundle([g[part] for g in grams], n[part])

    def count(batches):
        held, size = [], 0

        def sent():
            rows = list(bundles(held))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["shard", "words", "grams", "n"])

        for batch in batches:
            for pieces, first in _pieces(batch.column("text")):
                grams = _grams(pieces, first)
                _, place, n = _distinct(_key(grams))
                held.append(([g[place] for g in grams], n))
                size += len(place)
                if size > BUNDLED:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return texts.select("text").mapInArrow(count, "shard long, words binary, grams binary, n binary")


def _bucketed(model: DataFrame, shards: int) -> DataFrame:
    """The model written in buckets of shards, so that nothing that asks it shuffles it again."""
    spark, path = model.sparkSession, shared_folder(model.sparkSession, "model")
    name, buckets = path.rsplit("/", 1)[1].replace("-", "_"), -(-shards // BUCKET_SHARDS)
    model.repartition(buckets, "shard").write.bucketBy(buckets, "shard").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.named, table.written_to = name, path
    return table


def kneser_ney(texts: DataFrame, shards: int) -> tuple[DataFrame, dict[int, tuple[float, float, float]], tuple[float, float]]:
    """The table of the model, the discounts of each order, and (share of one count, p of an unseen piece) of order 1.

    The table holds, by shard, the counts of all n-grams and the sums of their
    contexts, from which a modified Kneser-Ney probability is made when it is asked
    for.  Lower orders count the different pieces seen before an n-gram.
    """
    spark = texts.sparkSession

    def merged(left: pa.Table) -> pa.Table:
        shard, parts = left.column("shard")[0].as_py(), [_unbundle(*(v.as_py() for v in row)) for row in zip(*(left.column(c) for c in ("words", "grams", "n")), strict=True)]
        grams = [np.concatenate(g) for g in zip(*(g for g, _ in parts), strict=True)]
        key = _key(grams)
        order = np.argsort(key)
        key = key[order]
        begin = _runs(key)
        n = np.add.reduceat(np.concatenate([n for _, n in parts])[order], begin)
        grams = [g[order[begin]] for g in grams]
        rows = [_counted(ORDER, shard, key[begin], n)]
        for level in range(ORDER, 1, -1):
            keys, sums = _summed(_key(grams[:-1]), _classes(n))
            rows += [("context", s, level - 1, _packed(keys[at]), b"".join(_planes(v[at]) for v in sums), *[None] * 6) for s, at in _by_shard(keys, shards)]
            tail, place, n = _distinct(_key(grams[1:]))
            grams = [g[place] for g in grams[1:]]
            if level > 2:
                rows.append(_counted(level - 1, shard, tail, n))
            else:  # the different pieces before one piece lie in many shards
                rows += [("piece", s, 1, _packed(tail[at]), _planes(n[at].astype(np.int64)), *[None] * 6) for s, at in _by_shard(tail, shards)]
        return _table(rows)

    def united(left: pa.Table) -> pa.Table:
        shard, rows = left.column("shard")[0].as_py(), []
        for kind, width in (("context", 4), ("piece", 1)):
            part = left.filter(pc.equal(left.column("kind"), kind))
            if part.num_rows:
                keys = np.concatenate([_unpacked(k.as_py()) for k in part.column("keys")])
                values = np.concatenate([_from_planes_of(v.as_py(), width) for v in part.column("values")], axis=1)
                keys, values = _summed(keys, values)
                rows.append(_counted(1, shard, keys, values[0]) if width == 1 else ("context", shard, 0, _packed(keys), b"".join(_planes(v) for v in values), *[None] * 6))
        return _table(rows)

    parts = written(ngram_counts(texts, shards).groupBy("shard").applyInArrow(merged, _COUNTED), "ngrams")
    released(spark)
    sums = written(parts.where("kind <> 'count'").groupBy("shard").applyInArrow(united, _COUNTED), "contexts")
    model = _bucketed(parts.where("kind = 'count'").union(sums), shards)
    dropped(parts, sums)
    released(spark)
    whole = model.where("kind = 'count'").groupBy("level").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "kinds"))).collect()  # one row an order
    discounts, base = {}, (0.0, 1.0)
    for r in whole:
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 + 2 * r.n2 else 0.5
        pairs = ((1, r.n1, r.n2), (2, r.n2, r.n3), (3, r.n3, r.n4))
        discounts[r.level] = tuple(max(0.1, min(k - 0.1, k - (k + 1) * y * after / this if this else k / 2)) for k, this, after in pairs)
        if r.level == 1:
            d1, d2, d3 = discounts[1]
            left = d1 * r.n1 + d2 * r.n2 + d3 * (r.kinds - r.n1 - r.n2)
            base = (1 / r.total, left / r.total / (r.kinds + 1))  # what is left goes to all pieces and one unseen alike
    return model, discounts, base


def _in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with _block, of neighbouring rows; written, so that every later pass sees the same blocks."""

    def rows(batches):
        part, size = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = utf8(batch.column("text"))[1]
            block = (part << 32) + (size + ends[:-1]) // BLOCK_BYTES
            size += int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], [*batch.schema.names, "_block"])

    return written(docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("_block", T.LongType())])), "blocks")


def _answers(docs: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """(_block, kind, keys, values): the counts and context sums that the model's shards hold of the n-grams of each block."""

    def asked(batches):
        def sent(block, held):
            keys, home = (np.concatenate(h) for h in zip(*held, strict=True))
            keys, place, _ = _distinct(keys)
            shard = home[place]
            order = np.argsort(shard, kind="stable")  # keys stay in order within a shard
            begin = _runs(shard[order])
            cells = np.split(order, begin[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[order[begin]], pa.int64()), pa.array(np.full(len(begin), block)), pa.array([_packed(keys[c]) for c in cells], pa.binary())], ["shard", "_block", "keys"]
            )

        now, held = None, []
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != now and held:
                    yield sent(now, held)
                    held = []
                now = blocks[a]
                for pieces, first in _pieces(batch.column("text").slice(a, b - a)):
                    if not len(pieces):
                        continue
                    grams, contexts = _chains(_grams(pieces, first))
                    # contexts are n-grams of the place before, but for those at a text's start
                    starts = first[:-1][np.diff(first) > 0]
                    keys = [*grams, *(c[starts] for c in contexts)]
                    home = [_shard(k, shards) for k in [*grams[:-1], grams[-2], *keys[len(grams) :]]]
                    distinct, place, _ = _distinct(np.concatenate(keys))
                    held.append((distinct, np.concatenate(home)[place].astype(np.int32)))
        if held:
            yield sent(now, held)

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        asks = [(block.as_py(), _unpacked(packed.as_py())) for block, packed in zip(right.column("_block"), right.column("keys"), strict=True)]
        for kind, held, packed in zip(*(left.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            keys, values = _unpacked(held), _from_planes_of(packed, 1 if kind == "count" else 4)
            if not len(keys):
                continue
            for block, own in asks:
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                there = keys[place] == own
                out.append((block, kind, _packed(own[there]), b"".join(_planes(v) for v in values[:, place[there]])))
        columns = zip(*out, strict=True) if out else [()] * 4
        types = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_block", "kind", "keys", "values"])

    queries = docs.select("_block", "text").mapInArrow(asked, "shard long, _block long, keys binary")
    return model.select("shard", "kind", "keys", "values").groupBy("shard").cogroup(queries.groupBy("shard")).applyInArrow(found, "_block long, kind string, keys binary, values binary")


class Model:
    """A model of some texts: its table, and what of it is the same for all n-grams."""

    def __init__(self, texts: DataFrame, shards: int) -> None:
        self.shards = shards
        self.table, self.discounts, self.base = kneser_ney(texts, shards)

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table.named}")
        dropped(self.table)

    def perplexities(self, docs: DataFrame, rounds: int = 1, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``docs`` with _pieces and _perplexity (null for a text without pieces) of every whole text, after ``kept``.

        The rows are scored in ``rounds`` parts, by a hash, one after the other, so
        that what a part shuffles is gone before the next.
        """
        part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds)) if rounds > 1 else None
        out = None
        for k in range(rounds):
            rows = docs if part is None else docs.where(part == k)
            blocks = _in_blocks(rows)
            scored = self._scores(blocks, docs.columns)
            scored = written(kept(scored) if kept else scored, "scored")
            dropped(blocks)
            released(docs.sparkSession)
            out = scored if out is None else out.union(scored)
        return out

    def _scores(self, blocks: DataFrame, names: list[str]) -> DataFrame:
        discounts, (unit, unseen) = {n: np.array([0.0, *d]) for n, d in self.discounts.items()}, self.base
        schema = T.StructType([*(f for f in blocks.schema.fields if f.name in names), T.StructField("_pieces", T.LongType()), T.StructField("_perplexity", T.DoubleType())])

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            held = {}
            for kind, width in (("count", 1), ("context", 4)):
                part = right.filter(pc.equal(right.column("kind"), kind))
                keys = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(k.as_py()) for k in part.column("keys"))])
                order = np.argsort(keys, kind="stable")
                values = np.concatenate([np.zeros((width, 0), np.int64), *(_from_planes_of(v.as_py(), width) for v in part.column("values"))], axis=1)
                # a column of zeros behind the last stands for all that the model does not hold
                held[kind] = keys[order], np.concatenate([values[:, order], np.zeros((width, 1), np.int64)], axis=1)

            def places(kind, distinct):
                keys = held[kind][0]
                place = np.searchsorted(keys, distinct)
                there = place < len(keys)
                there[there] = keys[place[there]] == distinct[there]
                return np.where(there, place, len(keys))

            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for pieces, first in _pieces(left.column("text")):
                grams, contexts = _chains(_grams(pieces, first))
                starts = first[:-1][np.diff(first) > 0]
                p, sums_before = np.full(len(pieces), unseen), None
                for n, own in enumerate(grams, 1):
                    if n not in discounts:
                        continue  # a model of no texts
                    # a context is the n-gram of the place before, but for those at a text's start
                    more = contexts[n - 1][starts] if n < ORDER else own[:0]
                    distinct, group = np.unique(np.concatenate([own, more]), return_inverse=True)
                    seen = held["count"][1][0][places("count", distinct)[group[: len(own)]]]
                    less = seen - discounts[n][np.minimum(seen, 3)]
                    if n == 1:
                        p = less * unit + unseen
                    else:
                        total, *classes = sums_before
                        left_over = sum(d * c for d, c in zip(discounts[n][1:], classes, strict=True))
                        p = np.where(total > 0, (less + left_over * p) / np.maximum(total, 1), p)
                    if n < ORDER:
                        place = places("context", distinct)[group]
                        before = np.empty(len(own), np.int64)
                        before[1:] = place[: len(own) - 1]
                        before[starts] = place[len(own) :]
                        sums_before = held["context"][1][:, before]
                total = np.concatenate([[0.0], np.cumsum(-np.log(p))])
                sums.append(np.diff(total[first]))
                sizes.append(np.diff(first))
            size = np.concatenate(sizes).astype(np.int64)
            value = pa.array(np.exp(np.concatenate(sums) / np.maximum(size, 1)), mask=size == 0)
            return pa.table([*(left.column(c) for c in names), pa.array(size), value], names=[*names, "_pieces", "_perplexity"])

        return blocks.groupBy("_block").cogroup(_answers(blocks, self.table, self.shards).groupBy("_block")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_symbols (pieces), perplexity, threshold, kept.

    Trusted are the documents with ``labels.quality`` 1.  One in HELD_OUT distinct
    trusted texts, by a hash of the text, is held out of the counts with all its
    copies; the quantile of their perplexities is each language's threshold.  A
    language without held-out texts takes the quantile of all of them; without any
    nothing is rejected.  Texts without pieces (null, empty, blanks only) have no
    perplexity and are not kept.  Null ids and languages are scored like others,
    repeated rows each, very long texts whole; other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return _scored(docs, labels, quantile, lambda scored: scored.select(
        "doc_id", "lang", F.col("_pieces").alias("n_symbols"), F.col("_perplexity").alias("perplexity"), F.col("_threshold").alias("threshold"), F.col("_kept").alias("kept")
    ))


def _scored(docs: DataFrame, labels: DataFrame, quantile: float, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``result`` of ``docs`` (doc_id, text, lang, ...) with _pieces, _perplexity, _threshold and _kept."""
    small_batches(docs.sparkSession)
    ids = checked_broadcast(written(trusted_ids(labels), "trusted"))
    trusted = docs.select("doc_id", "text", "lang").join(ids, "doc_id", "left_semi").where("text is not null")
    held = F.pmod(F.xxhash64("text", F.lit("held")), F.lit(HELD_OUT)) == 0
    size = F.sum(F.octet_length("text"))
    shards = max(1, -(-(trusted.where(~held).agg(size).first()[0] or 0) // MODEL_BYTES), -(-(docs.agg(size).first()[0] or 0) // (SHARD_BYTES * ROUNDS)))
    model = Model(trusted.where(~held), shards)
    own = model.perplexities(trusted.where(held).select("text", "lang"), 1, lambda scored: scored.where("_perplexity is not null").select("lang", "_perplexity"))
    limit = F.percentile_approx("_perplexity", quantile, 10_000)
    default = own.agg(limit).first()[0]
    limits = checked_broadcast(written(own.groupBy(F.col("lang").alias("_lang")).agg(limit.alias("_own")), "limits"), 64)
    released(docs.sparkSession)

    def judged(scored: DataFrame) -> DataFrame:
        scored = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        limit = F.coalesce("_own", F.lit(default).cast("double"))
        kept = F.col("_perplexity").isNotNull() & F.coalesce(F.col("_perplexity") <= limit, F.lit(True))
        return result(scored.withColumn("_threshold", limit).withColumn("_kept", kept).drop("_lang", "_own"))

    found = model.perplexities(docs, ROUNDS, judged)
    model.drop()
    return found


def keep_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns in their order."""
    rest = [c for c in docs.columns if c != "text"]
    # the text travels once, the other columns as they are beside it
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"))
    own = [F.col("text").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    return _scored(whole, labels, quantile, lambda scored: scored.where("_kept").select(*own))
