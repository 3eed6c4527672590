"""Paired Poisson bootstrap: resampling with replacement without gathering a segment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import first_words

#: Inverse distribution function of the Poisson law of mean 1, up to 7.
LADDER = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


#: What a partition returns: arrays of a number per draw.
SUMS = "run string, kind string, segment string, wd array<double>, w array<double>"

#: The first eight hexadecimal digits from which on a digest gives one more: as a number over 2**32 they compare with LADDER's steps the same.
STEPS = [f"{math.ceil(x * 2**32):08x}" for x in LADDER]


def digest(seed: int, key: Column, draw: Column) -> Column:
    """A function of seed, row key and draw: the same on any engine with MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), draw.cast("string")))


def weight_of(digest: Column) -> Column:
    """Poisson weight of a digest, best a column of its own, as it is read more than once."""
    out = F.lit(len(STEPS))
    for k in reversed(range(len(STEPS))):
        out = F.when(digest < STEPS[k], F.lit(k)).otherwise(out)
    return out


def poisson_weight(seed: int, key: Column, draw: Column) -> Column:
    """Weight of a row in a draw."""
    return weight_of(digest(seed, key, draw))


def _bands(sums: DataFrame, by: tuple[str, ...] = (), mean: Column | None = None) -> DataFrame:
    """Quantiles of the draws' means by segment."""
    q = F.percentile(F.try_divide(F.col("wd"), F.col("w")) if mean is None else mean, [0.025, 0.975])
    return sums.groupBy(*by, "kind", "segment").agg(q.alias("q")).select(*by, "kind", "segment", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _segments() -> Column:
    """Overall, block and hub of a row, as (kind, segment)."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("segment"))
    return F.array(one("overall", F.lit("overall")), one("block", F.col("block")), one("hub", F.col("hub")))


def bands_by_digest(rows: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """kind, segment, lo, hi from rows (key, block, hub, diff), by built-in functions; for few draws."""
    # digests come out of the generator with their draws, so that each is worked out once
    each = F.array(*[F.struct(F.lit(k).alias("draw"), digest(seed, F.col("key"), F.lit(k)).alias("digest")) for k in range(draws)])
    weighed = rows.select("block", "hub", "diff", F.inline(each)).filter(F.col("digest") >= STEPS[0]).withColumn("weight", weight_of(F.col("digest")))
    # sums of draws by block and hub first, which each segment then adds up
    part = weighed.groupBy("draw", "block", "hub").agg(F.sum(F.col("weight") * F.col("diff")).alias("wd"), F.sum("weight").alias("w"))
    part = part.withColumn("s", F.explode(_segments())).groupBy("draw", "s.kind", "s.segment").agg(F.sum("wd").alias("wd"), F.sum("w").alias("w"))
    return _bands(part)


def _draws(seed: int, draws: int, chunk: int = 256):
    """Sums of every segment by draw. Weights come from 16 bits each, four of a hash, by a table of the law: its steps are right to 1 / 65,536."""
    words = -(-draws // 4)
    rows_of = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    law = np.searchsorted(np.array(LADDER), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.float32)

    def weights(keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64)[:, None] + rows_of[None, :] + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.take(law, (x ^ (x >> np.uint64(31))).view(np.uint16), mode="clip")[:, :draws]  # all are inside; a quarter of the time of indexing

    return _summed(weights, "hashed", chunk, np.float32)


def _draws_by_digest(draws: int, chunk: int = 1024):
    """Sums of every segment by draw, with the weights of ``digest``; keys come as the text that stands before the draw."""
    named, steps = [str(k).encode() for k in range(draws)], [np.uint32(int(x, 16)) for x in STEPS]

    def weights(keys: np.ndarray) -> np.ndarray:
        found = first_words([k.encode() for k in keys], named)
        out = np.zeros(found.shape, np.uint8)
        for x in steps:
            out += found >= x
        return out.astype(np.float64)

    return _summed(weights, "prefix", chunk, np.float64)


def _summed(weights: Callable[[np.ndarray], np.ndarray], column: str, chunk: int, number: type):
    """Sums of weights and of weighed differences. Where a column ``known`` says that differences are null, a segment of such only has no sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        counted = set()
        for b in batches:
            coded = []
            for kind, columns in (("overall", ["run"]), ("block", ["run", "block"]), ("hub", ["run", "hub"])):
                codes = b.groupby(columns, dropna=False, sort=False).ngroup().to_numpy()
                some = b.iloc[np.unique(codes, return_index=True)[1]]
                of = some[kind] if kind != "overall" else ["overall"] * len(some)
                coded.append((codes, [(None if pd.isna(r) else r, kind, None if pd.isna(x) else x) for r, x in zip(some["run"], of, strict=True)]))
                at = codes[b["known"].to_numpy(dtype=bool)] if "known" in b else codes
                counted |= {coded[-1][1][c] for c in np.unique(at)}
            keys, diff = b[column].to_numpy(), b["diff"].to_numpy(dtype=number)
            for k in range(0, len(b), chunk):
                w, d = weights(keys[k : k + chunk]), diff[k : k + chunk]
                names, member = [], []
                for codes, segments in coded:
                    seen, at = np.unique(codes[k : k + chunk], return_inverse=True)
                    names += [segments[s] for s in seen]
                    member.append((at[None, :] == np.arange(len(seen))[:, None]).astype(number))
                m = np.concatenate(member)
                both = np.concatenate([m * d, m]) @ w  # sums of every segment in the chunk, for all draws at once
                for n, segment in enumerate(names):
                    found = both[[n, n + len(names)]].astype(np.float64)
                    sums[segment] = sums[segment] + found if segment in sums else found
        if sums:
            yield pd.DataFrame([(*segment, list(s[0]) if segment in counted else [None] * len(s[0]), list(s[1])) for segment, s in sums.items()], columns=["run", "kind", "segment", "wd", "w"])

    return run


def bands_by_digests(rows: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """kind, segment, lo, hi from rows (key, block, hub, diff): every row has the weight of ``digest`` in every draw, as in
    ``bands_by_digest``, but by arrays in tasks, for many draws.

    A null difference counts in the weights only. A draw in which a segment has no weight has no mean; it counts as NaN, above all others.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes are many draws' work
    prefix = F.concat_ws("|", F.lit(str(seed)), F.col("key").cast("string"), F.lit(""))
    diff = F.col("diff").cast("double")
    keyed = rows.select(F.lit("").alias("run"), prefix.alias("prefix"), F.col("block").cast("string").alias("block"), F.col("hub").cast("string").alias("hub"), F.coalesce(diff, F.lit(0.0)).alias("diff"), diff.isNotNull().alias("known"))
    sums = _by_draw(keyed.repartition(parts).mapInPandas(_draws_by_digest(draws), SUMS))
    mean = F.when(F.col("w") == 0, F.col("wd") * F.lit(float("nan"))).otherwise(F.try_divide(F.col("wd"), F.col("w")))
    return _bands(sums, mean=mean)


def _by_draw(parts: DataFrame) -> DataFrame:
    """A row per run, segment and draw from the partitions' arrays, whose elements add up."""
    long = parts.select("run", "kind", "segment", F.posexplode(F.arrays_zip("wd", "w")).alias("draw", "s"))
    return long.groupBy("run", "kind", "segment", "draw").agg(F.sum("s.wd").alias("wd"), F.sum("s.w").alias("w"))


def bands(rows: DataFrame, draws: int = 2000, seed: int = 7, by: str | None = None) -> DataFrame:
    """kind, segment, lo, hi from rows (key, block, hub, diff): 95 % bands of the mean difference, of each run where ``by`` names its column.

    Each partition returns two arrays of ``draws`` sums per segment and run; their elements
    add up. Bands agree with resampling rows in law, not draw by draw; an empty segment has no row.
    """
    run = F.col(by).cast("string") if by else F.lit("")
    hashed = rows.select(run.alias("run"), F.xxhash64("key").alias("hashed"), F.col("block").cast("string").alias("block"), F.col("hub").cast("string").alias("hub"), F.col("diff").cast("double").alias("diff"))
    out = _bands(_by_draw(hashed.mapInPandas(_draws(seed, draws), SUMS)), ("run",))
    return out.withColumnRenamed("run", by) if by else out.drop("run")
