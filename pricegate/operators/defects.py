"""Seeded defects: transforms of published rows that each check must be seen to catch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import ZONE, hours_in_local_day


def _at(hub: str, day: str, hour: int | None = None) -> Column:
    here = (F.col("hub") == hub) & (F.col("day") == F.lit(day).cast("date"))
    return here if hour is None else here & (F.col("hour") == hour)


def shift_hour(rows: DataFrame, hub: str, day: str) -> DataFrame:
    """The hub-day one hour early."""
    return rows.withColumn("hour", F.when(_at(hub, day), F.col("hour") - 1).otherwise(F.col("hour")))


def _copies(rows: DataFrame, hub: str, day: str) -> DataFrame:
    return rows.filter(_at(hub, day)).withColumn("seq", F.col("seq") + (1 << 40))


def retry(rows: DataFrame, hub: str, day: str) -> DataFrame:
    """The hub-day published once more, exactly."""
    return rows.unionByName(_copies(rows, hub, day))


def retry_with_conflict(rows: DataFrame, hub: str, day: str, hour: int = 17, delta: float = 3.0) -> DataFrame:
    """The hub-day once more, one real-time price off."""
    off = F.when(F.col("hour") == hour, F.col("price_rt") + delta).otherwise(F.col("price_rt"))
    return rows.unionByName(_copies(rows, hub, day).withColumn("price_rt", off))


def missing_hour(rows: DataFrame, hub: str, day: str, hour: int = 7) -> DataFrame:
    return rows.filter(~_at(hub, day, hour))


def unit_slip(rows: DataFrame, hub: str, day: str, unit: str = "USD/kWh") -> DataFrame:
    return rows.withColumn("unit", F.when(_at(hub, day), F.lit(unit)).otherwise(F.col("unit")))


def fake_hour(rows: DataFrame, hub: str, day: str, zone: str = ZONE) -> DataFrame:
    """One hour too many: the hub-day's first row with the position after the last."""
    names = [c for c in rows.columns if c not in ("hour", "seq")]
    first = rows.filter(_at(hub, day)).agg(F.min_by(F.struct(*names), "hour").alias("r"), F.max("seq").alias("seq")).filter("r is not null")
    extra = first.select(*[F.col("r")[c].alias(c) for c in names], (F.col("seq") + (1 << 40)).alias("seq"))
    extra = extra.withColumn("hour", (hours_in_local_day(F.col("day"), zone) + 1).cast(rows.schema["hour"].dataType))
    return rows.unionByName(extra.select(*rows.columns))


def forecast_unit_change(forecasts: DataFrame, from_day: str, factor: float = 1000.0) -> DataFrame:
    """Loads in another unit from a day on."""
    late = F.col("day") >= F.lit(from_day).cast("date")
    return forecasts.withColumn("load_forecast_mw", F.when(late, F.col("load_forecast_mw") * factor).otherwise(F.col("load_forecast_mw")))


ROW_DEFECTS: dict[str, Callable[..., DataFrame]] = {"hour_shift": shift_hour, "retry": retry, "conflict": retry_with_conflict, "missing_hour": missing_hour, "unit_slip": unit_slip, "fake_hour": fake_hour}
#: The checks that each defect must fail; the last two are of the forecasts and of serving.
EXPECTED = {
    "hour_shift": ["hour_count_days_wrong"], "retry": [], "conflict": ["duplicate_conflicts"], "missing_hour": ["hour_count_days_wrong"], "unit_slip": ["hour_count_days_wrong"], "fake_hour": [],
    "load_units": ["band_coverage", "psi_max"], "skew": ["band_coverage", "hub_no_regression", "overall_improvement", "peak_no_regression"],
}


def inject(rows: DataFrame, defect: str, hub: str, day: str, **more) -> DataFrame:
    if defect not in ROW_DEFECTS:
        raise ValueError(f"unknown defect {defect}")
    return ROW_DEFECTS[defect](rows, hub, day, **more)


def matrix(results: DataFrame) -> DataFrame:
    """defect, failed checks, expected ones, ok: from gate results whose run_id is the defect's name."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(d, sorted(c)) for d, c in EXPECTED.items()], "run_id string, expected array<string>")
    failed = results.groupBy("run_id").agg(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"))
    joined = failed.join(F.broadcast(wanted), "run_id")
    return joined.select(F.col("run_id").alias("defect"), F.array_join("failed", ",").alias("failed"), F.array_join("expected", ",").alias("expected"), (F.col("failed") == F.col("expected")).alias("ok"))
