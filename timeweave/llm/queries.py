"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe, languages, mixing, ngram_lm, quality, secrets, simhash, spelling, toxicity, url_filters, warc, whitening
from .common import read


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(read(spark, sf_dir, "documents"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # without an id a document has no fold; it is scored, not learned from
    held = F.coalesce(ngram_lm.held_out(), F.lit(True))
    return ngram_lm.score(docs, ngram_lm.train(docs.where(~held)), held)


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann_forest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.train(docs))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(toxicity.held_out(), F.lit(True))
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held), held)


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_captures(url_filters.captures_of(pages), url_filters.entries_of(pages), F.lit("2025-01-02").cast("timestamp"))
    return judged.withColumnRenamed("id", "page_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.apply(rows, whitening.fit(rows)).withColumnRenamed("id", "vec_id")


def op12_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(languages.held_out(), F.lit(True))
    found = languages.predict(docs, languages.train(docs.where(~held)), held)
    return found.withColumn("n_languages", F.size("languages")).drop("languages")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(read(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_kneser_ney, op3_prefix_forest, op4_warc_zstd, op5_byte_bpe, op6_secret_scan, op7_source_mix, op8_pu_toxicity, op9_temporal_url_filter, op10_simhash, op11_whitening, op12_language_mixture, op13_spelling_variants)}

ORACLES = {
    "op4_warc_zstd": """
with d as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b) as payload_bytes, sha1(b) as x from d),
k as (select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4),
    lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * i::int + 1, 5))::int >> (15 - 5 * j::int)) & 31), 1)), '')), '') as payload_digest from h),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from k)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to, null::varchar as error from f""",
    "op7_source_mix": mixing.ORACLE_SQL,
    "op9_temporal_url_filter": url_filters.ORACLE_SQL,
}
