"""The registered queries: each applies one operator to its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE`` holds DuckDB SQL
for those that SQL can express.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_extract, langid, lm_score, ngram_join, packing, suffix_dedup, topk, toxicity
from .common import crc_fold, table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels come from the folds other than 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels.where(crc_fold("doc_id", 5) != 0))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; learned from the folds other than 2 of 7."""
    docs = table(spark, sf_dir, "documents").withColumn("__learn", crc_fold("doc_id", 7) != 2)
    return lm_score.score_texts(docs, learn_col="__learn", class_col="lang")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_langid(docs.where(crc_fold("doc_id", 3) != 1))
    return langid.predict_langid(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have Jaccard similarity 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=5, num=75, den=100)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 75 * (p.n + q.n - common)
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b, c FROM reach JOIN links ON a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, each document ended by id 2."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors by a cosine of 0.9 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e)), true)
), unit AS (
  SELECT vec_id, x, sqrt(array_inner_product(x, x)) AS norm FROM (
    SELECT vec_id, CAST(list_transform(x, lambda e: e / largest) AS DOUBLE[64]) AS x FROM (
      SELECT vec_id, CAST(x AS DOUBLE[]) AS x, list_max(list_transform(CAST(x AS DOUBLE[]), lambda e: abs(e))) AS largest FROM v
    ) WHERE largest > 0
  )
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.vec_id <> q.vec_id
  WHERE array_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.9
), reach(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT b, c FROM reach JOIN links ON a = reach.vec_id
), least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages.select("page_id", "url", "html"), html_extract.fit_labeller(pages)).select("page_id", "url", "text", "n_chars")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), scale=256, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e)), true)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that repeat within the corpus; ``first`` marks the place that is kept."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), words=50).select("doc_id", "first", "start_word", "n_words")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), places AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM words WHERE len(w) >= 50)
), judged AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY passage) AS n, row_number() OVER (PARTITION BY passage ORDER BY doc_id, s) = 1 AS first FROM places
), marked AS (
  SELECT doc_id, first, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id, first ORDER BY s) > 50, true) AS begins FROM judged WHERE n > 1
), numbered AS (
  SELECT doc_id, first, s, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY doc_id, first ORDER BY s) AS part FROM marked
)
SELECT doc_id, first, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + 50 - min(s) AS INTEGER) AS n_words
FROM numbered GROUP BY doc_id, first, part
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_topk_search": op5_topk_search,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_lm_score": op9_lm_score,
    "op10_langid": op10_langid,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op5_topk_search": OP5_SQL,
    "op6_suffix_dedup": OP6_SQL,
}
