"""Paired errors by segment, coverage, pinball loss and the stability index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def segment_errors(scored: DataFrame, y: str = "y", champion: str = "p_champion", challenger: str = "p_challenger", block: str = "block", hub: str = "hub", by: tuple[str, ...] = ()) -> DataFrame:
    """(run and) kind, segment, n, both mean absolute errors and their mean difference: overall, by block and by hub in one aggregate."""
    a, b = F.abs(F.col(y) - F.col(champion)), F.abs(F.col(y) - F.col(challenger))
    out = scored.select(*by, F.col(block).alias("block"), F.col(hub).alias("hub"), a.alias("a"), b.alias("b"))
    sets = out.groupingSets([[*by, "block"], [*by, "hub"], [*by]], *by, "block", "hub")
    out = sets.agg((F.grouping_id() % 4).alias("g"), F.count("*").alias("n"), F.avg("a").alias("mae_champion"), F.avg("b").alias("mae_challenger"), F.avg(F.col("b") - F.col("a")).alias("diff"))
    kind = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "block").otherwise("hub")
    return out.select(*by, kind.alias("kind"), F.coalesce("block", "hub", F.lit("overall")).alias("segment"), "n", "mae_champion", "mae_challenger", "diff")


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(y.between(lo, hi).cast("double"))


def pinball(y: Column, lo: Column, hi: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """Mean of the pinball losses of both quantiles."""
    loss = lambda q, d: F.greatest(F.lit(q) * d, F.lit(q - 1) * d)
    return (F.avg(loss(low, y - lo)) + F.avg(loss(high, y - hi))) / 2


def psi(rows: DataFrame, features: list[str], reference: Column, bins: int = 10, floor: float = 1e-4, by: tuple[str, ...] = ()) -> DataFrame:
    """Stability index by feature (and run) of the other rows against the reference rows.

    Edges are the different deciles of the reference, the outer ones open; bins are [a, b).
    Shares below ``floor`` count as it, so empty bins are in. A constant reference gives 0.
    With ``by``, the columns of a run, the deciles of all runs come from one aggregate, in
    which a run's reference rows of one feature meet: those of a window of hours.
    """
    key = [*by, "feature"]
    long = rows.select(*by, reference.alias("ref"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot([*by, "ref"], features, "feature", "x").filter("x is not null")
    cuts = [k / bins for k in range(bins + 1)]
    some = long.filter("ref")
    deciles = some.groupBy(*key).agg(F.percentile("x", cuts).alias("q")) if by else quantiles(some, ["feature"], F.col("x"), cuts)
    edges = deciles.select(*key, F.array_distinct("q").alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(1)))).otherwise(F.array().cast("array<double>"))
    edges = edges.select(*key, inner.alias("inner"), (F.size("edges") > 1).alias("varies"))
    edges = edges if by else F.broadcast(edges)  # a row per feature
    dealt = long.join(edges, key).filter("varies").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("x"))))
    counts = dealt.groupBy(*key, "bin").agg(F.count(F.when(F.col("ref"), 1)).alias("r"), F.count(F.when(~F.col("ref"), 1)).alias("c"))
    every = edges.filter("varies").select(*key, F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    totals = counts.groupBy(*key).agg(F.sum("r").alias("rs"), F.sum("c").alias("cs"))
    full = every.join(counts, [*key, "bin"], "left").join(totals, key)
    share = lambda n, total: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.greatest(F.col(total), F.lit(1)), F.lit(floor))
    r, c = share("r", "rs"), share("c", "cs")
    out = full.groupBy(*key).agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    return edges.select(*key).join(out, key, "left").select(*key, F.coalesce("psi", F.lit(0.0)).alias("psi"))
