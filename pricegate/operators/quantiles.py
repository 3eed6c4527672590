"""Exact quantiles by counting: no group's values meet in one task, however many there are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which a pass cuts what is left, and values that are at last looked at one by one.
PARTS, FEW = 32, 4096
#: Accuracy of the sketch that the first pass takes its cuts from: just below and above each wanted rank.
ACCURACY = 20_000


def quantiles(rows: DataFrame, by: list[str], value: Column, at: list[float]) -> DataFrame:
    """by and q: the quantiles of each group, linear between neighbouring values. Groups are few; null and NaN are passed over.

    Up to FEW values in all come to the driver at once. Of more, values a little below and above
    each wanted rank are found by Spark's sketch; counting exactly below, at and between them
    tells on which of them the rank lies, or between which two, and what is there is cut again,
    into about equal parts, until it is few. A part lacks the values that it was cut by, so this
    ends whatever the values are: infinities, ties and far outliers are values like any other,
    as nothing is reckoned with them. A pass brings 2 * PARTS + 3 counts for each wanted rank to
    the driver (the first one 4 for each quantile, and one), the last one FEW values at most.
    """
    spark = rows.sparkSession
    own = rows.select(*by, value.cast("double").alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in by]
    few = own.limit(FEW + 1).collect()
    if len(few) <= FEW:
        held: dict[tuple, list[float]] = {}
        for r in few:
            held.setdefault(tuple(r[:-1]), []).append(r["__x"])
        found = [(*g, [_linear(q, sorted(xs)) for q in at]) for g, xs in held.items()]
    else:
        own = own.persist()
        found = _of_many(own, by, at, kinds)
        own.unpersist()
    return spark.createDataFrame(found, ", ".join([*kinds, "q array<double>"]))


def _ranks(q: float, n: int) -> tuple[int, int]:
    position = q * (n - 1)
    return math.floor(position), math.ceil(position)


def _linear(q: float, xs: list[float] | dict[int, float], n: int | None = None) -> float:
    """The quantile of sorted values, or of n values of which those at its ranks are known."""
    n = n or len(xs)
    low, high = _ranks(q, n)
    part = q * (n - 1) - low
    return xs[low] if xs[low] == xs[high] else (1 - part) * xs[low] + part * xs[high]


def _of_many(own: DataFrame, by: list[str], at: list[float], kinds: list[str]) -> list[tuple]:
    spark = own.sparkSession
    cuts = F.array_distinct(F.percentile_approx("__x", [k / PARTS for k in range(PARTS + 1)], 100 * PARTS)).alias("cuts")
    beside = sorted({min(max(q + side * 1.5 / ACCURACY, 0.0), 1.0) for q in at for side in (-1, 1)})
    groups = own.groupBy(*by).agg(F.count("*").alias("n"), F.array_distinct(F.percentile_approx("__x", beside, ACCURACY)).alias("cuts")).collect()
    # of each group and rank: what it lies between, not inclusive, and the values up to the lower end and between
    Span = tuple[float | None, float | None]
    spans: dict[tuple[int, int], tuple[Span, int, int]] = {(g, r): ((None, None), 0, row["n"]) for g, row in enumerate(groups) for q in at for r in _ranks(q, row["n"])}
    known: dict[tuple[int, int], float] = {}

    def within(wanted: list[tuple[int, Span]], listed: list[list[float]] | None = None) -> DataFrame:
        """Values beside each wanted span (its number k) of their group that holds them."""
        names = [f"__by{n}" for n in range(len(by))]
        table = spark.createDataFrame(
            [(*(groups[g][c] for c in by), k, *span, listed[k] if listed else []) for k, (g, span) in enumerate(wanted)],
            ", ".join([*(f"{n} {kind.rpartition(' ')[2]}" for n, kind in zip(names, kinds, strict=True)), "__k int, __a double, __b double, __cuts array<double>"]),
        )
        x, same = F.col("__x"), F.lit(True)
        for c, n in zip(by, names, strict=True):
            same = same & own[c].eqNullSafe(table[n])
        inside = (F.col("__a").isNull() | (x > F.col("__a"))) & (F.col("__b").isNull() | (x < F.col("__b")))
        return own.join(F.broadcast(table), same & inside)  # a row for each wanted rank at most

    first = True
    while wanted := sorted({(g, span) for (g, _), (span, _, n) in spans.items() if n > FEW}, key=str):
        if first:
            listed = [groups[g]["cuts"] for g, _ in wanted]
        else:
            found = {r["__k"]: r["cuts"] for r in within(wanted).groupBy("__k").agg(cuts).collect()}
            listed = [found[k] for k in range(len(wanted))]
        first = False
        listed = [sorted(xs) for xs in listed]
        # plain comparisons, as a lambda over the cuts costs many times as much
        below = sum((F.coalesce((F.get("__cuts", F.lit(k)) < F.col("__x")).cast("int"), F.lit(0)) for k in range(max(map(len, listed)))), F.lit(0)).alias("below")
        on = F.array_contains("__cuts", F.col("__x")).alias("on")
        counts: dict[int, dict] = {}
        for r in within(wanted, listed).groupBy("__k", below, on).agg(F.count("*").alias("n")).collect():
            counts.setdefault(r["__k"], {})[r["below"], not r["on"]] = r["n"]
        number = {key: k for k, key in enumerate(wanted)}
        for (g, rank), (span, before, n) in list(spans.items()):
            if n <= FEW:
                continue
            xs, done = listed[number[g, span]], before
            # a cut's place is after the values between it and the one before
            for (place, between), m in sorted(counts[number[g, span]].items(), key=lambda c: (c[0][0], not c[0][1])):
                if rank < done + m:
                    break
                done += m
            if between:
                spans[g, rank] = ((xs[place - 1] if place else span[0], xs[place] if place < len(xs) else span[1]), done, m)
            else:
                known[g, rank] = xs[place]
                del spans[g, rank]
    last = sorted({(g, span) for (g, _), (span, _, _) in spans.items()}, key=str)
    values = {last[r["__k"]]: r["xs"] for r in within(last).groupBy("__k").agg(F.array_sort(F.collect_list("__x")).alias("xs")).collect()} if last else {}
    known |= {(g, rank): values[g, span][rank - before] for (g, rank), (span, before, _) in spans.items()}
    return [(*(row[c] for c in by), [_linear(q, {r: known[g, r] for r in _ranks(q, row["n"])}, row["n"]) for q in at]) for g, row in enumerate(groups)]
