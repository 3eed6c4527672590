"""The numbered queries: each applies an operator, as set for production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, exact_dedup, html, packing, pieces, quality, resharding, rules, search, secrets, simhash, warc
from .common import input_table


def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards dealt by doc_id to 24 of equal bytes: written, rewritten by the plan and reread."""
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(resharding.OLD_SHARDS))
    rows = resharding.resharded(input_table(spark, sf_dir, "documents", "doc_id", "text"), old, resharding.OLD_SHARDS, resharding.SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, input_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(input_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(input_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(input_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(input_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(input_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(input_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return rules.apply(docs, input_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents", "doc_id", "text")
    return search.rank_documents(docs, input_table(spark, sf_dir, "benchmark", "item_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_flow_resharding, op2_quality_discriminant, op3_warc_archive, op4_exact_dedup, op5_simhash_near_dedup, op6_secret_randomness,
        op7_embedding_near_dedup, op8_html_main_text, op9_merge_dropout, op10_packing, op11_quality_rules, op12_token_alignment, op13_ranked_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_archive": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_embedding_near_dedup": embeddings.ORACLE, "op13_ranked_search": search.ORACLE}
