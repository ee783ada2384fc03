"""Cleaning and tokenising the corpus: quality, lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the last return
the columns of ``documents``. ``run`` writes every stage as Parquet into the shared checkpoint folder and
reads it again for the next, so that a lost executor costs one stage at most."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, decontam, jaccard, line_dedup, quality
from shelfspark.session import checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents that importance resampling takes."""
    return quality.Selection(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).choose(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: texts without repeated lines; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class the document with the least doc_id; rows without a doc_id stay.

    A document without words is a copy, all of whose lines stand in documents with a larger doc_id (the first stage takes
    none without words); it is near no other text any more, so it goes before the classes are made."""
    docs = docs.filter(F.col("doc_id").isNull() | F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x09-\\x0D ]"))
    classes = jaccard.near_duplicates(docs).filter(F.col("doc_id") > F.col("class_id")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(classes, F.col("doc_id") == F.col("gone"), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the documents that hold no test item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, token_ids, n_tokens, and whether the decoded tokens are the text again."""
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_resampling", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]

#: Trained models and hashed scores decide in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline_{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
