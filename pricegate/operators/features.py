"""Features known when the day-ahead market closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import clock_hour, hour_block
from .reconcile import KEY

NUMERIC = ["price_da", "load_forecast_mw", "lag2_spread", "roll7_spread"]


def daily_spread(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of price_rt - price_da by hub and day (and run, where ``by`` names its columns), over the hours with both prices."""
    return rows.filter("price_rt is not null").groupBy(*by, "hub", "day").agg(F.avg(F.col("price_rt") - F.col("price_da")).alias("spread"))


def spread_lags(spread: DataFrame, days: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """lag2_spread and roll7_spread of every (hub, day) of ``days``: the spread two calendar days back, and the mean of days 2 to 8 back.

    Runs on the daily grain over spread days and wanted days together, so a day without a
    spread of its own still gets its lags; gaps in the calendar count as gaps.
    """
    both = spread.withColumn("__want", F.lit(False)).unionByName(days.select(*by, "hub", "day").distinct().withColumns({"spread": F.lit(None).cast("double"), "__want": F.lit(True)}))
    back = Window.partitionBy(*by, "hub").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))
    lag2, roll7 = F.max("spread").over(back.rangeBetween(-2, -2)), F.avg("spread").over(back.rangeBetween(-8, -2))
    return both.withColumns({"lag2_spread": lag2, "roll7_spread": roll7}).filter("__want").select(*by, "hub", "day", "lag2_spread", "roll7_spread")


def build(final: DataFrame, preliminary: DataFrame, forecasts: DataFrame, lag_from: str = "preliminary", by: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows: final hours with a real-time price and a forecast, and lags of the preliminary spread.

    ``lag_from="verified"`` takes the lags from the final rows, which is a leak and there to
    show one. Rows with a null lag or load are left out.
    ``by``: columns of the run, which all three tables then have.
    """
    sources = {"preliminary": preliminary, "verified": final}
    if lag_from not in sources:
        raise ValueError(f"lag_from: {lag_from}")
    rows = final.filter("price_rt is not null").join(forecasts.select(*by, *KEY, "load_forecast_mw"), [*by, *KEY])
    rows = rows.withColumn("y", F.col("price_rt") - F.col("price_da")).withColumn("clock_hour", clock_hour(F.col("day"), F.col("hour")))
    rows = rows.withColumns({"block": hour_block(F.col("clock_hour")), "weekday": (F.weekday("day") < 5).cast("double")})
    lags = spread_lags(daily_spread(sources[lag_from], by), rows, by)
    return rows.join(lags, [*by, "hub", "day"]).dropna(subset=["lag2_spread", "roll7_spread", "load_forecast_mw"])


def design(hubs: list[str], interactions: bool = False, skew: bool = False) -> dict[str, Column]:
    """Columns of the design by name: numbers, weekday, blocks, a dummy for each hub but the first; with the squared price and its peak product.

    ``skew`` puts the squared price to zero, as a serving path that lost it would.
    """
    da, peak = F.col("price_da"), (F.col("block") == "peak").cast("double")
    out = {c: F.col(c).cast("double") for c in NUMERIC} | {"weekday": F.col("weekday"), "is_peak": peak, "is_shoulder": (F.col("block") == "shoulder").cast("double")}
    out |= {f"hub_{h}": (F.col("hub") == h).cast("double") for h in hubs[1:]}
    if interactions:
        out |= {"da_sq": F.lit(0.0) * da if skew else da * da, "peak_x_da": peak * da}  # fixed values: their names
    return out


def windows(first_day: Column, split_day: int, monitor_from_day: int, reference_days: int, day: str = "day") -> Column:
    """"train", "test" or "after" by days since the first one, and whether the day is in the reference, as a struct."""
    n = F.datediff(F.col(day), first_day)
    name = F.when(n < split_day, "train").when(n < monitor_from_day, "test").otherwise("after")
    return F.struct(name.alias("name"), ((n < split_day) & (n >= split_day - reference_days)).alias("reference"))
