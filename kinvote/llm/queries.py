"""Registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinvote.llm import (
    decontamination,
    filter_audit,
    language_id,
    licenses,
    mixing,
    pii,
    ranked_search,
    repetition,
    sentencepiece_bpe,
    sharding,
    sketch_join,
    url_filters,
    warc,
)
from kinvote.llm.common import small_batches
from kinvote.session import scratch_path

SHARDS = 8
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
CHUNK_BYTES = 64 << 10
MODEL = "piece_bpe_32k.model"
RANKED_DOCS = 50
PSEUDONYM_KEY = "corpus pseudonyms"
"""Where the session names no secret in ``spark.kinvote.pseudonymKey``."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.drop("representative")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.shard_slots(docs, "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def judge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), "page_id", "url", "html", URL_RULES)


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = scratch_path(spark, "archives")
    warc.archive_pages(pages, path, chunk_bytes=CHUNK_BYTES)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, path).select(
        F.when(F.col("key") != "null", F.col("key")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_measures(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_covered_words",
    )


def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.kinvote.pseudonymKey", PSEUDONYM_KEY)
    found = pii.pseudonymise(docs, "text", key, counts="found")
    return found.select("doc_id", "text", *[F.col(f"found.{k}").alias(f"n_{k}") for k in pii.KINDS])


def scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(_table(spark, sf_dir, "documents"))


def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encoding_digests(docs, "doc_id", "text", public_tokenizers.path(MODEL))


def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return ranked_search.ranked(docs, items, RANKED_DOCS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate,
    "op2_ngram_jaccard": ngram_jaccard,
    "op3_sharding": shards,
    "op4_mixing": mix_sources,
    "op5_url_filters": judge_pages,
    "op6_warc": archive_pages,
    "op7_quality": quality,
    "op8_pii": pseudonymise,
    "op9_licenses": scan_licenses,
    "op10_language": languages,
    "op11_sentencepiece": encode_pieces,
    "op12_filter_audit": audit_filters,
    "op13_ranked_search": search_items,
}
