"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage.llm.common import Words, checked_broadcast, small_batches, word_chunks, written

#: Labelled rows that the classifier is fitted on, at most (in the order of a hash of the id).
MAX_TRAIN = 12_000
#: Entries of the learned lexicon, at most.
MAX_LEXICON = 4_096
PREFIX = 4
CUT = 0.7

#: Words of insult every lexicon starts with.
INSULTS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb")
#: Second-person words of the corpus's languages.
SECOND_PERSON = ("you", "your", "yours", "u", "tu", "te", "toi", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "usted", "ti", "tus", "ustedes")

_COLUMNS = [
    "strong_density", "strong_count", "weak_density", "log_odds_mean", "log_odds_top", "second_person_density", "second_person_near",
    "capital_share", "capital_words", "exclamation_density", "punctuation_density", "digit_in_word", "sign_in_word", "repeated_letters", "log_words",
]

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()-"]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "@$*#%&_+|"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word without marks at its ends: of its first bytes and of the whole."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _MARKS[words.data[end - 1]]
        start += (end - start > 1) & _MARKS[words.data[start]]
    whole = words.hashes(start, end)
    front = words.hashes(start, np.minimum(start + PREFIX, end)) ^ np.uint64(1)
    return np.where(end - start > PREFIX, front, whole), whole


def _hashed(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(Words(data, np.array([0, len(data)])).hashes())


def learn_lexicon(sample: DataFrame) -> dict[str, np.ndarray]:
    """Terms (whole words and word beginnings) of toxic texts of the sample, with log odds.

    ``sample`` (text, toxic) is bounded, and so is what is returned.
    """

    def terms(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for row, end, words in word_chunks(batch.column("text")):
                front, whole = _terms(words)
                pairs = np.unique(np.stack([np.concatenate([front, whole]).view(np.int64), np.concatenate([words.row, words.row])]), axis=1)
                label = toxic[row:end][pairs[1]] == 1
                term, place = np.unique(pairs[0], return_inverse=True)
                bad = np.bincount(place, label, len(term)).astype(np.int64)
                all_ = np.bincount(place, minlength=len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(bad), pa.array(all_)], ["term", "bad", "n"])

    sums = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, clean = float(sums.bad or 0), float(sums.n - (sums.bad or 0))
    counted = sample.select("text", "toxic").mapInArrow(terms, "term long, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (clean + 1))
    best = counted.where("bad >= 3").withColumn("odds", odds).where("odds >= 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(MAX_LEXICON).toPandas()
    known = _hashed(INSULTS)
    term = np.concatenate([best["term"].to_numpy(np.int64).view(np.uint64), known])
    value = np.concatenate([best["odds"].to_numpy(float), np.full(len(known), 4.0)])
    term, first = np.unique(term, return_index=True)
    return {"term": term, "odds": value[first], "you": _hashed(SECOND_PERSON)}


def _looked_up(keys: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
    return np.where(terms[place] == keys, values[place], 0.0)


def _features(words: Words, lexicon: dict[str, np.ndarray]) -> np.ndarray:
    rows = len(words.offsets) - 1
    data, row = words.data, words.row
    byte_row = np.repeat(np.arange(rows), np.diff(words.offsets))

    def by_word(mask, weights=None):
        return np.bincount(row[mask], None if weights is None else weights[mask], rows)

    def by_byte(mask):
        return np.bincount(byte_row[mask], minlength=rows)

    front, whole = _terms(words)
    odds = np.maximum(_looked_up(front, lexicon["term"], lexicon["odds"]), _looked_up(whole, lexicon["term"], lexicon["odds"]))
    you = np.isin(whole, lexicon["you"])
    strong, weak = odds >= 3.5, odds > 0
    count = np.bincount(row, minlength=rows)
    per = np.maximum(count, 1)
    reach = np.cumsum(np.concatenate([[0], you]))
    place = np.arange(len(row))
    low = np.maximum(place - 5, words.first[:-1][row]) if len(row) else place
    high = np.minimum(place + 6, words.first[1:][row]) if len(row) else place
    near = strong & (reach[high] - reach[low] > 0)
    top = np.zeros(rows)
    np.maximum.at(top, row, odds)
    sums = [np.concatenate([[0], np.cumsum(kind[data])]) for kind in (_LETTERS, _CAPITALS, _DIGITS, _SIGNS)]
    letters, capitals, digits, signs = (s[words.end] - s[words.start] for s in sums)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTERS[data[2:]]
    spread = np.maximum(np.diff(words.offsets), 1)
    letter = np.maximum(by_byte(_LETTERS[data]), 1)
    return np.stack([
        by_word(strong) / per, np.minimum(by_word(strong), 50), by_word(weak) / per, by_word(weak, odds) / per, top, by_word(you) / per, by_word(near) / per,
        by_byte(_CAPITALS[data]) / letter, by_word((capitals == letters) & (letters > 1)) / per, by_byte(data == ord("!")) / spread, by_byte(_MARKS[data]) / spread,
        by_word((digits > 0) & (letters > 0)) / per, by_word((signs > 0) & (letters > 0)) / per, by_byte(inner) / spread, np.log1p(count),
    ])


def dense_features(docs: DataFrame, lexicon: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with one double column per feature in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in docs.columns if c != "text"]

    def compute(batches):
        lexicon = shared.value
        for batch in batches:
            parts = [_features(words, lexicon) for _, _, words in word_chunks(batch.column("text"))]
            values = np.concatenate(parts, axis=1) if parts else np.zeros((len(_COLUMNS), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in values)], [*kept, *_COLUMNS])

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in _COLUMNS)])
    return docs.mapInArrow(compute, schema)


def _fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3


def _trained(docs: DataFrame, labels: DataFrame, max_train: int):
    """The lexicon, the trees and the calibration, or None where a class is missing."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(_fold(F.col("doc_id").cast("long")) != 1)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labelled")
    picked = picked.withColumn("use", F.abs(F.xxhash64("doc_id", F.lit("use"))) % 6)
    # the scan keeps its own tasks; only the small sample is read by few
    sample = written(docs.join(checked_broadcast(picked), "doc_id").select("text", "toxic", "use"), "sample").coalesce(4)
    if sample.agg(F.countDistinct("toxic")).first()[0] < 2:
        return None
    lexicon = learn_lexicon(sample.where("use < 3"))
    features = written(dense_features(sample.where("use >= 3"), lexicon).coalesce(2), "features")
    gathered = VectorAssembler(inputCols=_COLUMNS, outputCol="features")
    ready = gathered.transform(features.withColumn("label", F.col("toxic").cast("double")))
    fit = ready.where("use < 5")
    if fit.agg(F.countDistinct("label")).first()[0] < 2:
        fit = ready
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=7).fit(fit)
    raw = trees.transform(ready.where("use = 5")).select(vector_to_array("probability")[1].alias("features"), "label")
    if not raw.head(1):
        raw = trees.transform(ready).select(vector_to_array("probability")[1].alias("features"), "label")
    steps = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="score").fit(raw)
    return lexicon, gathered, trees, steps


def _scored(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """``docs`` without text, with score."""
    small_batches(docs.sparkSession)
    model = _trained(docs.select("doc_id", "text"), labels, max_train)
    if model is None:
        return docs.drop("text").withColumn("score", F.lit(0.0))
    lexicon, gathered, trees, steps = model
    kept = [c for c in docs.columns if c != "text"]
    rated = trees.transform(gathered.transform(dense_features(docs, lexicon)))
    rated = rated.select(*kept, vector_to_array("probability")[1].alias("features"))
    rated = steps.transform(rated)
    # equal calibrated scores keep the trees' order
    blend = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("score") + 0.02 * F.col("features")))
    return rated.select(*kept, blend.alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    held_out: crc32 of the id as text, modulo 3, is 1; labels of such rows are never
    read.  score is in 0 to 1, predicted is 1 from CUT on.  Null and empty texts have
    features of zero and are scored like others; null ids are scored and not held
    out; repeated rows are scored each; other columns are ignored; an empty table
    gives no rows; with labels of one class only, or none, every score is 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(docs, labels, max_train).select(
        "doc_id", F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns in their order."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*fields).alias("_row"))
    return _scored(whole, labels, max_train).where(F.col("score") < CUT).select("_row.*")
