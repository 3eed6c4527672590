"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, stored, unused

#: Counters of each partition's Misra-Gries summary.
COUNTERS = 1024
#: A digest with more than this share of all rows is frequent.
SHARE = 1 / 256


def summarise(digests: Iterator[str], counters: int = COUNTERS) -> Counter:
    """Misra-Gries: each count is low by at most n / (counters + 1)."""
    kept: Counter = Counter()
    for d in digests:
        if d in kept or len(kept) < counters:
            kept[d] += 1
        else:
            kept = Counter({k: n - 1 for k, n in kept.items() if n > 1})
    return kept


def _partition_summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = summarise(d for b in batches for d in b["digest"])
    if kept:
        yield pd.DataFrame({"digest": list(kept), "low": list(kept.values())})


def frequent_digests(keys: DataFrame, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """Candidates that hold every digest with more than ``share`` of the rows.

    Summaries of partitions are summed by digest; a sum is low by at most n / (counters + 1),
    so all sums above n * (share - 1 / (counters + 1)) are taken: at most
    1 / (share - 1 / (counters + 1)) digests, 341 as set here, whatever n is.
    """
    n = keys.count()
    low = keys.select("digest").mapInPandas(_partition_summary, "digest string, low long")
    return low.groupBy("digest").agg(F.sum("low").alias("low")).filter(F.col("low") > n * (share - 1 / (counters + 1))).select("digest")


def digest_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, code points and the SHA-256 of each text without ASCII white space; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(whole, " \t\n\x0b\x0c\r", "")
    return docs.select("doc_id", F.length(whole).alias("points"), F.sha2(plain.cast("binary"), 256).alias("digest"))


def _winners(keys: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id")))
    return keys.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), "group_size")


def groups(docs: DataFrame, text: str = "text", counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with most code points, then least doc_id (null last) stays. Frequent digests are
    counted exactly and their winners broadcast, so their rows never travel; the others
    shuffle by digest, each with at most ``share`` of the rows. An empty table gives no rows;
    repeated rows (same doc_id and text) share one keep_id, so each is marked kept.
    """
    keys = stored(digest_keys(docs, text), "digests")
    candidates = F.broadcast(frequent_digests(keys, counters, share))
    hot = F.broadcast(stored(_winners(keys.join(candidates, "digest")), "winners"))
    rest = keys.join(hot.select("digest"), "digest", "left_anti")
    cold = stored(_winners(rest), "cold")
    out = keys.join(hot, "digest").unionByName(rest.join(cold, "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays.

    Null texts count as empty, and a null doc_id as greater than all others; an empty table
    gives no rows; columns may have any names.
    """
    marked = stored(groups(docs, text), "marked")
    stay, twice, id_, digest, own = (unused(n, docs) for n in ("stay", "twice", "id", "digest", "own"))
    stays = marked.filter("kept").select(F.col("doc_id").alias(stay)).distinct()
    gone = marked.filter("not kept").select("doc_id")
    kept = drop_ids(docs, gone.join(stays, gone["doc_id"].eqNullSafe(F.col(stay)), "left_anti"))
    repeated = stored(marked.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice)), "twice")
    if repeated.isEmpty():
        return kept
    # doc_ids of several rows: their rows are settled among themselves, text by text
    same = kept["doc_id"].eqNullSafe(F.col(twice))
    plain = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), " \t\n\x0b\x0c\r", "")
    some = kept.join(repeated, same, "left_semi").withColumn(own, F.sha2(plain.cast("binary"), 256))
    winners = marked.filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest)).distinct()
    some = some.join(winners, some[own].eqNullSafe(F.col(digest)) & some["doc_id"].eqNullSafe(F.col(id_)), "left_semi")
    return kept.join(repeated, same, "left_anti").unionByName(some.dropDuplicates(["doc_id", own]).drop(own))


#: DuckDB's form of ``groups``.
ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM k
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
