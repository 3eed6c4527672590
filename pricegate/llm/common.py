"""Shared folder, size-checked broadcasts and skew-safe joins used by the operators."""

from __future__ import annotations

import os
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete, new_folder

#: Most rows of a skinny table that are broadcast once their number has been counted.
BROADCAST_ROWS = 200_000


#: Folders that ``stored`` has written since the innermost ``stored_alone`` of this thread began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which cuts the lineage. It is deleted when the application ends, or before."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (written := _written.get()) is not None:
        written.append(path)
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes stored tables that no later read needs, as what was made of them is stored itself."""
    for t in tables:
        if path := t if isinstance(t, str) else getattr(t, "stored_at", None):
            delete(spark, path)


def stored_alone(spark: SparkSession, make, tag: str) -> DataFrame:
    """The stored table of ``make()``; whatever that stored on the way is deleted."""
    outer, own = _written.get(), []
    token = _written.set(own)
    try:
        out = stored(make(), tag)
    finally:
        _written.reset(token)
    discard(spark, *(p for p in own if p != out.stored_at))
    if outer is not None:
        outer.append(out.stored_at)
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if the counted rows are at most ``rows``; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_groups(rows: DataFrame, key: str, aggs: list[Column], share: float = 1 / 1000) -> DataFrame:
    """Every row beside its group's aggregates and ``group_size``.

    ``rows`` should be a stored table (it is read several times) and ``key`` not null. A key
    with more than ``share`` of all rows is joined by broadcast (there are at most 1 / share
    of those); the others by an ordinary shuffle, where no key is large.
    """
    stats = stored(rows.groupBy(key).agg(F.count("*").alias("group_size"), *aggs), "groups")
    least = max(rows.count() * share, 64)
    hot = F.broadcast(stats.filter(F.col("group_size") > least))
    cold = stats.filter(F.col("group_size") <= least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def join_hot(left: DataFrame, right: DataFrame, key: str, other: str, share: float = 1 / 1000) -> DataFrame:
    """Left join of ``left`` to a stored ``right`` with one row per key (column ``other``).

    ``right`` is broadcast if its counted rows are few. Else the keys with more than ``share``
    of the left rows (at most 1 / share of them) are broadcast, and only the rest is shuffled.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), left[key] == right[other], "left")
    left = stored(left, "left")
    counts = left.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__rows"))
    hot = F.broadcast(stored(counts.filter(F.col("__rows") > left.count() * share).select("__hot"), "hot"))
    few = F.broadcast(right.join(hot, right[other] == F.col("__hot"), "left_semi"))
    some = left.join(hot, left[key] == F.col("__hot"), "left_semi")
    rest = left.join(hot, left[key] == F.col("__hot"), "left_anti")
    return some.join(few, some[key] == few[other], "left").unionByName(rest.join(right, rest[key] == right[other], "left"))


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, or with as many underscores behind it as it takes to be no column of the tables."""
    while any(name in t.columns for t in tables):
        name += "_"
    return name


def drop_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped``; columns and their order stay."""
    name = unused("gone", docs)
    gone = stored(dropped.select(F.col(key).alias(name)).distinct(), "dropped")
    return docs.join(broadcast_if_small(gone), docs[key].eqNullSafe(F.col(name)), "left_anti")


def input_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that extra ones cannot clash."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select(*columns)


def text_size(col: str) -> Column:
    return F.octet_length(F.coalesce(F.col(col), F.lit("")))
