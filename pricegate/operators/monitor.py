"""Daily error of a model in production against the band that its training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_mae(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, day: str = "day") -> DataFrame:
    return scored.groupBy(*(by or []), day).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def control_band(daily: DataFrame, by: list[str] | None = None, days: int = 60, floor: float = 0.5, day: str = "day") -> DataFrame:
    """band_lo and band_hi: mean of the daily errors of the last days (the last one and ``days`` before it), two sample deviations either way, the lower edge at least ``floor``."""
    by = by or []
    last = F.max(day).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    recent = daily.withColumn("__last", last).filter(F.col(day) >= F.date_sub("__last", days))
    m, s = F.avg("mae"), F.stddev_samp("mae")
    return recent.groupBy(*by).agg(F.greatest(m - 2 * s, F.lit(floor)).alias("band_lo"), (m + 2 * s).alias("band_hi"))


def outside(daily: DataFrame, band: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Daily errors with their series' band and whether they lie outside of it; bands are one row a series, or a single row."""
    joined = daily.join(band, by) if by else daily.join(F.broadcast(band))
    return joined.withColumn("outside", F.coalesce((F.col("mae") > F.col("band_hi")) | (F.col("mae") < F.col("band_lo")), F.lit(False)))


def streaks(marked: DataFrame, by: list[str] | None = None, day: str = "day") -> DataFrame:
    """``streak``: consecutive rows outside up to and with each row, by gaps and islands."""
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a series has one row a day
    island = F.sum((~F.col("outside")).cast("int")).over(series.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("__island", island)
    run = Window.partitionBy(*(by or []), "__island").orderBy(day)
    return rows.withColumn("streak", F.sum(F.col("outside").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("__island")


def triggers(marked: DataFrame, by: list[str] | None = None, length: int = 3, day: str = "day") -> DataFrame:
    """First day on which each series has been outside for ``length`` rows in a row; null if never."""
    return streaks(marked, by, day).groupBy(*(by or [])).agg(F.min(F.when(F.col("streak") == length, F.col(day))).alias("trigger_day"))
