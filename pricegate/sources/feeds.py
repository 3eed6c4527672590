"""Price and forecast feeds: from published files to rows by (hub, day, hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.calendar import with_positions
from ..functions.numbers import cents_of, nanos
from .files import read_table

#: The eleven hubs of the contract.
HUBS = ["CAPITL", "CENTRL", "DUNWOD", "GENESE", "HUD VL", "LONGIL", "MHK VL", "MILLWD", "N.Y.C.", "NORTH", "WEST"]
#: Formats of stamps that begin an hour and that end an interval.
HOURLY, INTERVAL = "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss"
PRICES = "file_day date, time_stamp string, zone string, ptid int, lbmp double, losses double, congestion double"
UNIT = "USD/MWh"


def only_hubs(rows: DataFrame, hubs: list[str] | DataFrame, zone: str = "zone") -> DataFrame:
    """Rows of the listed zones, or of those in a table of hubs, which Spark broadcasts if it is small."""
    if isinstance(hubs, list):
        return rows.filter(F.col(zone).isin(hubs))
    return rows.join(hubs, zone, "left_semi")


def hourly_positions(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Hourly rows (file_day, time_stamp, zone, seq) with day and hour; stamps begin the hour."""
    at = F.to_timestamp_ntz("time_stamp", F.lit(HOURLY)) if stamp is None else stamp
    rows = rows.withColumns({"day": F.col("file_day"), "clock": F.hour(at) + 1, "minute": F.lit(0)})
    return with_positions(rows, ["zone"], "day", "clock", "minute", ["seq"]).drop("clock", "minute")


def integrate_intervals(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Interval prices to the hour, weighted by interval length: (zone, day, hour, price_rt, intervals).

    Stamps end an interval, so the next midnight closes the last hour. An interval lasts from
    the stamp before it in its zone and day; a length of zero or less, as of a repeated stamp or
    where the repeated hour begins anew, counts as 5 minutes, and on a 23-hour day the first one
    after the gap counts the gap. A null price keeps its weight. One shuffle by (zone, day)
    serves the windows and the aggregate.
    """
    at = F.to_timestamp_ntz("time_stamp", F.lit(INTERVAL)) if stamp is None else stamp
    micros = F.timestamp_diff("MICROSECOND", F.col("file_day").cast("timestamp_ntz"), at)
    rows = rows.select("zone", F.col("file_day").alias("day"), "lbmp", "seq", F.bround(micros / F.lit(6e7)).cast("int").alias("minutes"))
    rows = rows.repartition("zone", "day")
    length = F.col("minutes") - F.lag("minutes", 1, 0).over(Window.partitionBy("zone", "day").orderBy("seq"))
    minute = F.col("minutes") % 60
    rows = rows.withColumns({"weight": F.when(length <= 0, 5).otherwise(length).cast("double"), "clock": F.greatest(F.ceil(F.col("minutes") / 60).cast("int"), F.lit(1)), "minute": F.when(minute == 0, 60).otherwise(minute)})
    rows = with_positions(rows, ["zone"], "day", "clock", "minute", ["seq"])
    price = F.coalesce(F.sum(F.col("weight") * F.col("lbmp")), F.lit(0.0)) / F.sum("weight")
    return rows.groupBy("zone", "day", "hour").agg(price.alias("price_rt"), F.count("*").alias("intervals"))


def forecast_vintage(wide: DataFrame, zones: list[str], day: str = "day", issued: str = "file_day", seq: str = "seq") -> DataFrame:
    """(hub, day, hour, load_forecast_mw) known a day ahead: rows issued on the day before.

    ``wide`` has a column per zone and a clock column; values that are no numbers are dropped.
    """
    rows = wide.filter(F.col(day) == F.date_add(F.col(issued), 1)).withColumn("minute", F.lit(0))
    rows = with_positions(rows, [], day, "clock", "minute", [seq])
    text = rows.select(day, "hour", *[F.col(f"`{z}`").cast("string").alias(z) for z in zones])
    long = text.unpivot([day, "hour"], zones, "zone", "mw")
    return long.select(F.upper(F.trim("zone")).alias("hub"), F.col(day).alias("day"), "hour", F.expr("try_cast(mw AS double)").alias("load_forecast_mw")).dropna(subset=["load_forecast_mw"])


def _rows(joined: DataFrame, unit: str, status: str) -> DataFrame:
    """Contract rows of prices, with two decimals; each price's whole number is a column before it is rounded."""
    prices = ["price_da", "price_rt"]
    whole = bound(joined, {f"__{p}": nanos(F.col(p)) for p in prices})
    near = bound(whole.select(F.col("zone").alias("hub"), "day", "hour", *[F.col(p).alias(f"__raw_{p}") for p in prices], *[f"__{p}" for p in prices]), {p: cents_of(F.col(f"__raw_{p}"), F.col(f"__{p}")) for p in prices})
    return near.select("hub", "day", "hour", *prices, F.lit(unit).alias("unit"), F.lit(status).alias("status"))


def published_rows(day_ahead: DataFrame, real_time: DataFrame, unit: str = UNIT) -> DataFrame:
    """Preliminary rows: every day-ahead hour, with the integrated price where there is one; two decimals."""
    joined = day_ahead.select("zone", "day", "hour", "price_da").join(real_time.select("zone", "day", "hour", "price_rt"), ["zone", "day", "hour"], "left")
    return _rows(joined, unit, "preliminary")


def verified_rows(day_ahead: DataFrame, hourly: DataFrame, unit: str = UNIT) -> DataFrame:
    """Revisions: hours of the publisher's hourly price that the day-ahead price has too; two decimals."""
    joined = hourly.select("zone", "day", "hour", "price_rt").join(day_ahead.select("zone", "day", "hour", "price_da"), ["zone", "day", "hour"])
    return _rows(joined, unit, "verified")


def feed_extent(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def read_prices(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """A normalised price table of CSV files, with ``seq``, the order of publication: by file name, then place in the file.

    An absent table is an error, or empty where it is optional. Parts of a file are numbered
    by where they begin, so that the order does not depend on how files are dealt to tasks.
    """
    rows = read_table(spark, path, PRICES, required)
    if not rows.inputFiles():
        return rows.withColumn("seq", F.lit(None).cast("long"))
    columns = rows.columns
    rows = rows.select(*columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__begin"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__line"))
    parts = rows.select("__file", "__begin").distinct().withColumn("__place", F.row_number().over(Window.orderBy("__file", "__begin")).cast("long"))  # a row for each part of a file
    return rows.join(parts, ["__file", "__begin"]).select(*columns, (F.shiftleft("__place", 33) + F.col("__line")).alias("seq"))
