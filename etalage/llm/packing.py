"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import chunks, small_batches, utf8, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
OPEN_WINDOWS = 32
#: Sequence ids of merged leftovers start here; those of a partition at its number times 2^32.
MERGED = 1 << 62
#: Pieces of one generation that a task remembers; it holds two.
REMEMBERED = 400_000
#: Pieces of letters that one call of the tokenizer encodes.
CALL_WORDS = 64
#: Texts are cut and looked up in parts of about this many bytes, whole documents each.
PART_BYTES = 2 << 20
#: Kinds of bytes: a blank or line feed, a Latin letter (those of two bytes are found in the text), a mark without an apostrophe, any other.
_BLANK, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,!?:;|#$%&*()-")] = _MARK
#: The lower form of a byte of a Latin letter: A-Z, and the second byte of À-Þ.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32
_LETTERS = re.compile("[a-zà-öø-ÿ]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, place long, ids array<int>"


class _Memory:
    """Ids by piece in two generations: when the younger is full, what was not used since the last time goes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def missing(self, pieces: list[bytes]) -> list[bytes]:
        """Those of the pieces that are not known; ones of the older generation become young."""
        if len(self.young) > self.size:
            self.young, self.older = {}, self.young
        young, older, new = self.young, self.older, []
        for piece in pieces:
            if piece not in young:
                ids = older.get(piece)
                if ids is None:
                    new.append(piece)
                else:
                    young[piece] = ids
        return new


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of some texts (their bytes, and where each begins) and each text's first piece.

    The tokenizer never joins text across a blank or a line feed.  A word of Latin letters, then marks, is cut
    in two, as its ids are those of the two parts; the letters are lowered, as the tokenizer would.
    """
    size = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)]  # À-ÿ without the signs of product and quotient
    kind[lead] = kind[lead + 1] = _LETTER
    before = np.zeros(size, np.uint8)
    before[1:] = kind[:-1]
    before[offsets[:-1][offsets[:-1] < size]] = _BLANK
    text = kind != _BLANK
    begins = text & (before == _BLANK)
    word = np.flatnonzero(begins)
    if not len(word):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    letter = kind == _LETTER
    odd = (kind == _OTHER) | (letter & (before == _MARK))
    plain = letter[word] & ~np.logical_or.reduceat(odd, word)
    within = np.zeros(size, bool)
    within[word[0] :] = np.repeat(plain, np.diff(word, append=size))
    begins |= within & (kind == _MARK) & (before == _LETTER)
    data = np.where(within & letter, _LOWER[data], data)[text]
    piece = np.flatnonzero(begins)
    ends = np.cumsum(np.add.reduceat(text, piece, dtype=np.int64))
    cut = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)])
    return cut, np.searchsorted(piece, offsets)


class Encoder:
    """Ids of whole texts, each distinct piece encoded once as long as a task remembers it (as bytes of 32-bit numbers)."""

    def __init__(self, tokenizer: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = _Memory(REMEMBERED)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Pieces of letters go some to a call: an id that ends a word parts them."""
        known, letters = self.known.young, []
        for piece in pieces:
            text = piece.decode()
            if _LETTERS.fullmatch(text):
                letters.append(text)
            else:
                known[piece] = self._encode(text).tobytes()
        for at in range(0, len(letters), CALL_WORDS):
            group = letters[at : at + CALL_WORDS]
            ids = self._encode(" ".join(group))
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            data, start = ids.tobytes(), 0
            for text, end in zip(group, ends, strict=True):
                known[text.encode()] = data[start:end]
                start = end

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null counts as empty."""
        data, offsets = utf8(column)
        for row, end in chunks(offsets, PART_BYTES):
            part = offsets[row : end + 1]
            cut, first = _pieces(data[part[0] : part[-1]], part - part[0])
            cut = cut.dictionary_encode()
            distinct = cut.dictionary.to_pylist()
            self.learn(self.known.missing(distinct))
            found = list(map(self.known.young.__getitem__, distinct))
            ids = np.frombuffer(b"".join(found), np.int32)
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin = np.cumsum(size) - size
            place = cut.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(size[place])])
            ids = ids[np.repeat(begin[place] - ends[:-1], size[place]) + np.arange(ends[-1])]
            bounds = ends[first].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield ids[a:b]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _fill(documents: Iterator[tuple[int | None, np.ndarray]], part: int, window: int, open_windows: int) -> Iterator[tuple]:
    """Rows of PIECES; those with ids are in windows that stayed open."""
    opened: list[list] = []  # gap, pieces
    sequence = part << 32

    def closed(pieces: list) -> Iterator[tuple]:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), _crc(ids), total, sequence, offset, part, None, None
            offset += len(ids)
        sequence += 1

    for doc, ids in documents:
        start, total = 0, len(ids)
        while total - start >= window:
            yield from closed([(doc, start, ids[start : start + window], total)])
            start += window
        while start < total:
            left = total - start
            fits = [w for w in opened if w[0] >= left]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(opened) < open_windows:
                best = [window, []]
                opened.append(best)
            else:  # none fits: the fullest one takes what it can hold and leaves
                best = min(opened, key=lambda w: w[0])
            take = min(left, best[0])
            best[1].append((doc, start, ids[start : start + take], total))
            best[0] -= take
            start += take
            if not best[0]:
                yield from closed(best[1])
                opened = [w for w in opened if w is not best]
    place = 0
    for _, pieces in opened:
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), None, total, None, None, part, place, ids
            place += 1


def file_order(docs: DataFrame) -> dict[tuple[str, int], int] | None:
    """The number of each split (file, first byte) of written docs in the order they were written in; None for others.

    Spark reads the largest files first and several in one task, so a read partition says nothing of the order.
    """
    try:
        splits = docs.select("_metadata.file_name", "_metadata.file_block_start").distinct()
    except AnalysisException:
        return None

    def place(split):
        number = re.match(r"part-(\d+)", split[0])
        return (int(number[1]) if number else -1, *split)

    return {split: n for n, split in enumerate(sorted(map(tuple, splits.collect()), key=place))}


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, in_file_order: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text) in sequences of at most ``window`` ids.

    Each partition keeps ``open_windows`` windows: a document's rest goes where it
    fits best; when it fits nowhere, the fullest window is filled up by a cut and
    emitted.  What the partitions leave open is laid end to end, by prefix sums,
    and cut at the window's length, so only the very last sequence needs padding.

    With ``in_file_order`` each split of the files that ``docs`` is read from is packed
    by itself, and sequences are numbered in the order of the files' names.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: each
    id (``end_id`` after each document's own) is in exactly one piece.  A null or
    empty text is the single ``end_id``; a null doc_id and repeated rows are packed
    as they are; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "place")], ("ids", pa.list_(pa.int32()))])

    def rows(batches):
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()

        def documents():
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    ids = encoder.texts(some.column("text"))
                    parts = [part] * some.num_rows if splits is None else [splits[s] for s in zip(some.column("file").to_pylist(), some.column("at").to_pylist(), strict=True)]
                    for own_part, doc, own in zip(parts, some.column("doc_id").to_pylist(), ids, strict=True):
                        yield own_part, doc, np.append(own, np.int32(end_id))

        out: list[tuple] = []
        for row in chain.from_iterable(_fill((d[1:] for d in own), n, window, open_windows) for n, own in groupby(documents(), lambda d: d[0])):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    splits = file_order(docs) if in_file_order else None
    place = [] if splits is None else [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place)
    laid = written(docs.mapInArrow(rows, PIECES), "packed")
    full = laid.where("ids is null").drop("part", "place", "ids")
    left = laid.where("ids is not null")
    sums = left.groupBy("part").agg(F.sum("length").alias("size"))
    base = sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    before = F.sum("length").over(Window.partitionBy("part").orderBy("place")) - F.col("length")
    placed = left.withColumn("before", before).join(base, "part").withColumn("at", F.col("base") + F.col("before"))

    @F.pandas_udf("long")
    def crc32(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: _crc(np.asarray(x)))

    last = F.floor((F.col("at") + F.col("length") - 1) / window)
    cut = placed.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / window), last)))
    cut = cut.withColumn("from", F.greatest(F.col("at"), F.col("k") * window)).withColumn("to", F.least(F.col("at") + F.col("length"), (F.col("k") + 1) * window))
    size = F.col("to") - F.col("from")
    merged = cut.select(
        "doc_id",
        (F.col("start") + F.col("from") - F.col("at")).alias("start"),
        size.alias("length"),
        crc32(F.slice("ids", (F.col("from") - F.col("at") + 1).cast("int"), size.cast("int"))).alias("ids_crc32"),
        "doc_tokens",
        (F.col("k") + F.lit(MERGED)).alias("sequence_id"),
        (F.col("from") - F.col("k") * window).alias("offset"),
    )
    return full.unionByName(merged)
