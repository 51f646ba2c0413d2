"""Count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etalage.llm.common import small_batches

VOCABULARY = "piece_bpe_32k.model"
#: Fixed values of the tokenizer's rules: the word mark, and how far an unknown sign is below the least score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers before it starts anew.
REMEMBERED = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a vocabulary file, in id order.

    The file ranks its pieces (score: minus the rank); a unigram model needs log
    probabilities, and takes Zipf's law for them: -ln(rank + 2).  Pieces without a
    rank (signs and white-space runs) take the last rank's score.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    ranks = [-model.get_score(i) for i in range(size)]
    last = max(r for r in ranks if r < size)
    return [(model.id_to_piece(i), -float(np.log(min(r, last) + 2.0))) for i, r in enumerate(ranks) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class PieceCounter:
    """Best score and piece count of words, by one pass of an automaton over each.

    Rules: a word is a mark and the text up to the next blank or mark; a text that
    starts with neither gets one; other white space is ordinary text; of two ways with the same score the one whose last piece starts
    first wins; a character without a piece of its own may stand as unknown, with
    the least score less UNKNOWN_PENALTY, and counts one piece per UTF-8 byte.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        size = len(word)
        score: list[float | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        score[0] = 0.0
        single = [False] * (size + 1)
        done = 0  # ends up to here are settled

        def settle(until: int) -> None:
            nonlocal done
            while done < until:
                done += 1
                if not single[done]:
                    value = score[done - 1] + self.unknown
                    if score[done] is None or value > score[done]:
                        score[done], count[done] = value, count[done - 1] + len(word[done - 1].encode("utf-8", "replace"))

        for last, (length, own) in self.automaton.iter(word):  # by end; longest first
            end = last + 1
            settle(end - 1)
            if length == 1:
                single[end] = True
            value = score[end - length] + own
            if score[end] is None or value > score[end]:
                score[end], count[end] = value, count[end - length] + 1
        settle(size)
        return score[size], count[size]

    def text(self, text: str) -> tuple[float, int, int]:
        """Score, pieces and words of a whole text."""
        if not text:
            return 0.0, 0, 0
        total, pieces, known = 0.0, 0, self.known
        text = text.replace(" ", MARK)
        words = (text[1:] if text[0] == MARK else text).split(MARK)
        for word in words:
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = self.word(MARK + word)
            total += found[0]
            pieces += found[1]
        return total, pieces, len(words)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_words, score.

    Whole texts are counted; ``score`` is the log probability of the best ways of
    their words.  Null and empty texts have no tokens; null ids and repeated rows
    are counted like others; other columns are ignored; an empty table gives no
    rows.  ``path`` is a vocabulary file every machine holds; without it, that of
    the installed public vocabularies.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches):
        import public_tokenizers

        counter = PieceCounter(vocabulary(path or public_tokenizers.path(VOCABULARY)))
        for batch in batches:
            score, pieces, words = zip(*(counter.text(t.as_py() or "") for t in batch.column("text")), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_words", "score"])

    fields = [("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("n_words", T.LongType()), ("score", T.DoubleType())]
    return docs.mapInArrow(rows, T.StructType([T.StructField(*f) for f in fields]))
