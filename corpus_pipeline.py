"""A corpus from raw documents: quality rules, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder as Parquet
and reads it back as the next stage's documents. Nulls, empty texts, repeated rows and empty tables are what each operator's
docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import bpe, common, mixing, near_copies, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base counts pass."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return near_copies.drop(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact_documents(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("secret scan", secret_scan), ("source mix", mix_sources), ("byte-level bpe", encode)]

#: SQL has no Zstandard, XXH64 of a seed, network or byte-level merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = common.new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
