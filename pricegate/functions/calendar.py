"""Hours of a local day by position, so that days of 23 and 25 hours need no special case.

Time is UTC inside; days and labels are local. All expressions take TIMESTAMP_NTZ and so do
not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Clock hours of the blocks; all others are off-peak.
PEAK, SHOULDER = (12, 19), ((8, 11), (20, 22))


def local_midnight_utc(day: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def hours_in_local_day(day: Column, zone: str = ZONE) -> Column:
    """23, 24 or 25: the span between two local midnights. An error if it is not whole."""
    minutes = F.timestamp_diff("MINUTE", local_midnight_utc(day, zone), local_midnight_utc(F.date_add(day, 1), zone))
    hours = F.floor(minutes / 60).cast("int")
    return F.when(minutes % 60 == 0, hours).when(minutes.isNotNull(), F.raise_error(F.lit("a local day is not whole hours")).cast("int"))


def intervals_in_local_day(day: Column, minutes: int = 5, zone: str = ZONE) -> Column:
    return F.floor(hours_in_local_day(day, zone) * 60 / minutes).cast("int")


def hour_ending_utc(day: Column, hour: Column, zone: str = ZONE) -> Column:
    """UTC instant at which the hour at a position ends; null outside of the day."""
    end = local_midnight_utc(day, zone) + F.make_dt_interval(F.lit(0), hour.cast("int"))
    return F.when(hour.between(1, hours_in_local_day(day, zone)), end)


def clock_hour(day: Column, hour: Column, zone: str = ZONE) -> Column:
    """The clock's hour-ending at a position; the repeated hour is 2 again."""
    n = hours_in_local_day(day, zone)
    shifted = F.when((n == 25) & (hour >= 3), hour - 1).when((n == 23) & (hour >= 2), hour + 1).otherwise(hour)
    return F.when(hour.between(1, n), shifted.cast("int"))


def hour_ending_label(day: Column, hour: Column, zone: str = ZONE) -> Column:
    """Two digits of the clock hour; a star marks the second pass of the repeated hour."""
    digits = F.lpad(clock_hour(day, hour, zone).cast("string"), 2, "0")
    return F.when((hours_in_local_day(day, zone) == 25) & (hour == 3), F.concat(digits, F.lit("*"))).otherwise(digits)


def utc_to_local_day_hour(ts: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """(day, position) of the hour that ends at a UTC instant; midnight belongs to the day it ends."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    date = local.cast("date")
    day = F.when(local == date.cast("timestamp_ntz"), F.date_add(date, -1)).otherwise(date)
    return day, F.timestamp_diff("HOUR", local_midnight_utc(day, zone), ts).cast("int")


def hour_block(clock: Column) -> Column:
    shoulder = clock.between(*SHOULDER[0]) | clock.between(*SHOULDER[1])
    return F.when(clock.between(*PEAK), "peak").when(shoulder, "shoulder").otherwise("off_peak")


def with_positions(rows: DataFrame, keys: list[str], day: str, clock: str, minute: str, order: list[str], zone: str = ZONE) -> DataFrame:
    """Adds ``hour``, the position in the local day, to rows numbered by the clock in publication order.

    Only the days with a clock change differ from the clock. On the 25-hour day the rows of
    clock hour 2 pass to position 3 where their minutes stop rising, or from the second row on
    if they never do (also when there was one pass only).
    """
    pass_ = Window.partitionBy(*keys, day, clock).orderBy(*order)
    restart = F.coalesce(F.col(minute) <= F.lag(minute).over(pass_), F.lit(False)).cast("int")
    whole = Window.partitionBy(*keys, day, clock)
    marked = rows.withColumn("__restart", restart).withColumn("__n", hours_in_local_day(F.col(day), zone))
    so_far = F.max("__restart").over(pass_.rowsBetween(Window.unboundedPreceding, 0))
    second = F.when(F.max("__restart").over(whole) == 1, so_far == 1).otherwise(F.row_number().over(pass_) >= 2)
    c = F.col(clock)
    hour = (
        F.when(F.col("__n") == 23, F.when(c >= 3, c - 1).otherwise(c))
        .when(F.col("__n") == 25, F.when(c >= 3, c + 1).when((c == 2) & second, F.lit(3)).otherwise(c))
        .otherwise(c)
    )
    return marked.withColumn("hour", hour.cast("int")).drop("__restart", "__n")
