"""The operators as registered queries, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from etalage.llm import sql
from etalage.llm.common import table
from etalage.llm.conversation_trie import conversation_trie
from etalage.llm.html import extract_text
from etalage.llm.lexical import ranked_search
from etalage.llm.licenses import CONTAINMENT, NOTICES, license_scan
from etalage.llm.mixing import mix_sources
from etalage.llm.ngram_join import ngram_jaccard_join
from etalage.llm.packing import pack
from etalage.llm.quality import quality_scores
from etalage.llm.secrets import secret_scan, span_digest
from etalage.llm.tokens import token_counts
from etalage.llm.topk import top_k
from etalage.llm.toxicity import toxicity_scores
from etalage.llm.vector_dedup import vector_dedup


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "template", "license", "n_shared", "n_shingles", "containment")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secret_scan(table(spark, sf_dir, "documents")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_exact_top_k, op3_ngram_jaccard_join, op4_toxicity, op5_quality_classifier,
        op6_embedding_near_dedup, op7_source_mixing, op8_token_counts, op9_packing, op10_html_extraction,
        op11_secret_scan, op12_conversation_trie, op13_ranked_search,
    )
} | {"pipeline": corpus_pipeline.run}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(NOTICES))
    words = "regexp_extract_all(" + _LOWER.format("text") + ", '[\\p{L}\\p{N}]+')"
    return f"""
    WITH t(template, license, text) AS (VALUES {rows}),
    tw AS (SELECT template, license, {words} AS w FROM t),
    ts AS (SELECT template, license, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s FROM tw),
    tn AS (SELECT template, count(*) AS n FROM ts GROUP BY 1),
    dw AS (SELECT doc_id, {words} AS w FROM documents),
    ds AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s FROM dw),
    m AS (SELECT doc_id, template, license, count(*) AS n_shared FROM ds JOIN ts USING (s) GROUP BY ALL)
    SELECT doc_id, template, license, n_shared, n AS n_shingles, n_shared / n AS containment
    FROM m JOIN tn USING (template) WHERE n_shared / n >= {CONTAINMENT}"""


_TOP_K = """
    WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter([isfinite(x) FOR x IN embedding], lambda x: x IS NULL OR NOT x)) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
        FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5"""

_JOIN = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    d AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM d),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (n - k)),
    b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.reach = b.x),
    c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, component_id FROM d JOIN c USING (doc_id)"""

_DEDUP = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter([isfinite(x) FOR x IN embedding], lambda x: x IS NULL OR NOT x)) = 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_inner_product(a.v, b.v) >= 0.95 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) AND list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0),
    r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.reach = l.x),
    c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
    n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

ORACLE: dict[str, str] = {
    "op1_license_scan": _licenses(),
    "op2_exact_top_k": _TOP_K,
    "op3_ngram_jaccard_join": _JOIN,
    "op6_embedding_near_dedup": _DEDUP,
    "op11_secret_scan": sql.secrets(),
    "op12_conversation_trie": sql.CONVERSATIONS,
    "op13_ranked_search": sql.LEXICAL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
