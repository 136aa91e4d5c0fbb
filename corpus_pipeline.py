"""A training-data pipeline: quality filter, near-dedup, secret redaction, mixing, encoding. Counts as part of recollect.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again.
Columns of docs pass through all stages but the last, whatever their names, and keep their values. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, mixing, near_dup, quality, secrets
from recollect.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject.

    A null or empty text has the score of no features. Each row is judged by its text alone, repeated rows alike.
    """
    p = quality.Params()
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), p)
    score = "score"
    while score in docs.columns:
        score += "_"
    return quality.classify(docs, model, p, score=score).where(F.col(score) >= p.threshold).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id.

    Null and empty texts are groups of their own; rows alike in all columns stay once, other rows of a document that stays all stay.
    """
    return near_dup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced in their texts and n_chars, if there is one, counted anew. Null texts stay null, with their n_chars."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes their words, to the nearest whole number; those without words are never taken. A null source is one of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the hash of what they decode to. A null text is an empty one."""
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_dup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
