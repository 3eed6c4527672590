"""A corpus from raw documents to packed sequences; each stage's table is stored and read again."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricegate.llm import exact_dedup, packing, quality, secrets, simhash, similar
from pricegate.llm.common import discard, input_table, stored_alone


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be good, all columns.

    A null text is scored as an empty one, a very long one as a whole; equal texts stay or go
    together, so repeated rows do; a score of exactly 0.5 stays; an empty table gives no rows.
    """
    return quality.keep_good(docs, input_table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space, the one with most code points, then the least doc_id, all columns.

    A null text counts as empty, and a null doc_id as greater than all others; of rows that
    repeat doc_id and text one stays; an empty table gives no rows.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of their 5-word shingles of 0.8 or more, or through others, the row with the least doc_id, all columns.

    Texts without words, null ones too, are alike; rows with a null doc_id stay; rows that
    repeat a doc_id stay or go together; an empty table gives no rows.
    """
    return simhash.deduplicate(docs, words=similar.WORDS, similarity=similar.SIMILARITY)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with every secret found in a text replaced by a mask; n_chars follows.

    Null texts stay null; repeated rows are changed alike; overlapping spans are masked as
    one; an empty table gives no rows.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens; see ``packing.pack``.

    A null text is an empty document; rows that repeat a doc_id, or have none, are documents
    of their own; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("secret scan", redact), ("packing", pack)]

#: SQL cannot express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, on the documents; what a stage stored on the way is deleted when its own table is written."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(spark, before)
    return docs
