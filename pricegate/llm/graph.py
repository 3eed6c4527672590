"""Connected components by alternating large-star and small-star steps on stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_hot, stored


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """Rows (u, v) beside m, the least of u and its neighbours. The centre of a large star is no large group anywhere:
    its edges meet in partial aggregates, and its least is broadcast. ``few``: the edges' counted number bounds that of all leasts."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    joined = edges.join(F.broadcast(least), edges["u"] == least["__u"]) if few else join_hot(edges, stored(least, "least"), "u", "__u")
    return joined.drop("__u")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node reachable.

    Self-loops and repeated edges do no harm; an empty input gives an empty result. Each
    round costs joins and partial aggregates on the current edge table, which the steps turn
    into stars in a logarithmic number of rounds; nothing is gathered on the driver but the
    table's count and checksum.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(rounds):
        few = 2 * mark[0] <= BROADCAST_ROWS  # a step makes no more edges than there are
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large")
        near = _with_least(large, few)
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        was, e = e, stored(small.filter("u <> v").distinct(), "small")
        discard(e.sparkSession, was, large)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
