"""The corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes every stage's result as
Parquet to the cluster's shared folder and reads it again as the next one's documents, so a
lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbflow.llm import langid, ngram_join, packing, suffix_dedup, toxicity
from verbflow.llm.common import crc_fold, ensure_checkpoint_dir, table

#: A text whose best language has a lower mean probability than this is rejected as none.
LEAST_LANGUAGE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled folds other than 0 of 5."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0)
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or with no language that stands out, go."""
    model = langid.fit_langid(docs.where(crc_fold("doc_id", 3) != 1))
    return langid.predict_langid(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, once.

    Rows are told apart by id and a hash of all their columns, so different texts that share
    an id are documents of their own, and rows that are equal throughout are one.  Rows without an id
    come after all others.
    """
    names, kind = docs.columns, docs.schema["doc_id"].dataType
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.xxhash64(*names).alias("row"))
    keyed = docs.withColumn("__key", key)
    found = ngram_join.jaccard_components(keyed, id_col="__key", n=5, num=75, den=100)
    kept = found.where("__key = component_id").select("__key").distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(names)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place only; n_chars follows the text."""
    return suffix_dedup.remove_repeats(docs, words=50).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in as few sequences as the search finds."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeats),
    ("packing", pack_sequences),
]

#: No SQL expresses the trained stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
