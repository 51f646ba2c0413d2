"""A corpus pipeline over documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etalage.llm.common import checked_broadcast, table, written
from etalage.llm.mixing import in_mixed_order
from etalage.llm.ngram_join import ngram_jaccard_join
from etalage.llm.packing import pack
from etalage.llm.quality import keep_quality
from etalage.llm.toxicity import drop_toxic

#: SQL expresses neither the trees nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above the perplexity threshold of their language go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once.

    Texts without words are in no group and stay.
    """
    joined = ngram_jaccard_join(docs)
    gone = written(joined.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    names = docs.columns
    rest = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*names)
    again = written(joined.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.head(1):
        return rest
    repeated = rest.join(checked_broadcast(again), "doc_id", "left_semi").select(*names).dropDuplicates(["doc_id"])
    return rest.join(checked_broadcast(again), "doc_id", "left_anti").select(*names).union(repeated)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, numbered along the mixture."""
    return pack(docs, in_file_order=True)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
