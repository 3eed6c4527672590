"""Feeds derived from the driver's tables, so that every operator runs on data that grows with them."""

from __future__ import annotations

import io
import os
import zipfile
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import clock_hour, hour_block, hours_in_local_day
from ..operators.contract import Contract
from . import feeds
from .folders import stored

TYPES = ["click", "error", "purchase", "signup", "view"]
#: One type is left out of the known hubs and the upper price is tight, so that every reason occurs.
EVENTS = Contract(hubs=("click", "error", "purchase", "view"), high=300.0)
FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def interval_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular real-time prices: zone, file_day, stamp, lbmp, seq."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.to_date("ts").alias("file_day"), F.col("ts").alias("stamp"), F.col("value").alias("lbmp"), F.col("event_id").alias("seq"))


def daily_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): for each day of events a zip archive with a CSV file named by the day. Days differ in the order and the names of columns."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        day = frame["day"].iat[0]
        frame = frame.sort_values("event_id")
        columns = {"Time Stamp": frame["stamp"], "Name": frame["zone"], "PTID": frame["user_id"].astype(str), "LBMP ($/MWHr)": frame["price"], "Other": frame["zone"]}
        if day.day % 2:
            columns = {" " + k.upper() if k != "Other" else k: v for k, v in reversed(columns.items())}
        if day.day % 3 == 0:
            columns["Marginal Cost Losses ($/MWHr)"] = frame["zone"].str[:2]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{day:%Y%m%d}zone.csv", pd.DataFrame(columns).to_csv(index=False))
            z.writestr("readme.txt", "not a table")
        return pd.DataFrame({"path": [f"archive/{day:%Y%m%d}zone_csv.zip"], "content": [held.getvalue()]})

    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("stamp"), F.col("event_type").alias("zone"), F.format_string("%.4f", "value").alias("price"))
    return events.groupBy("day").applyInPandas(run, "path string, content binary")


def real_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.integrate_intervals(interval_feed(spark, sf_dir), F.col("stamp"))


def _cells(spark: SparkSession, sf_dir: str, value: Column, name: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("zone"), F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("hour")).agg(F.avg(value).alias(name))


def day_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, _k(), "price_da")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher's own hourly price."""
    return _cells(spark, sf_dir, F.col("value"), "price_rt")


def forecast_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per zone; every hour is issued one and two days before."""
    events = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "clock": F.hour("ts") + 1})
    wide = events.groupBy("day", "clock").pivot("event_type", TYPES).agg(F.avg("user_id"))
    return wide.withColumn("ahead", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"file_day": F.date_sub("day", F.col("ahead")), "seq": F.col("clock")})


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.forecast_vintage(forecast_wide(spark, sf_dir), TYPES)
    return out.withColumn("hub", F.lower("hub"))


def _seq() -> Column:
    return (F.datediff("day", F.lit("1970-01-01").cast("date")) * 100 + F.col("hour")).cast("long")


def preliminary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.published_rows(day_ahead(spark, sf_dir), real_time(spark, sf_dir)).withColumn("seq", _seq())


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified rows; those of every fifth hour are published twice, the second time without prices, and some are of days that never were."""
    rows = feeds.verified_rows(day_ahead(spark, sf_dir), hourly(spark, sf_dir)).withColumn("seq", _seq())
    again = rows.filter("hour % 5 = 0").withColumns({"price_rt": F.lit(None).cast("double"), "seq": F.col("seq") + (1 << 40)})
    ghosts = rows.filter("hour = 1").withColumn("day", F.add_months("day", 72))
    return rows.unionByName(again).unionByName(ghosts)


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows of every hour of every day between the first and the last; empty cells are 50."""
    cells = day_ahead(spark, sf_dir).join(hourly(spark, sf_dir), ["zone", "day", "hour"], "full_outer")
    span = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")).withColumn("hour", F.explode(F.sequence(F.lit(1), hours_in_local_day(F.col("day")))))
    grid = grid.withColumn("zone", F.explode(F.array(*[F.lit(t) for t in TYPES])))
    rows = grid.join(cells, ["zone", "day", "hour"], "left").fillna(50.0, ["price_da", "price_rt"])
    return feeds.published_rows(rows, rows).withColumn("seq", _seq())


@dataclass(frozen=True)
class ReleaseFeeds:
    """What a release is decided on: published rows and verified ones of every hour, and loads."""

    rows: DataFrame
    revisions: DataFrame
    forecasts: DataFrame


def release_feeds(spark: SparkSession, sf_dir: str) -> ReleaseFeeds:
    """Prices and loads of every hour of the days of events, moved by the means of the hour's events.

    The real-time price has a term in the squared day-ahead price, more at the peak, and the
    load moves with that square, so that the challenger is better and both models lean on the
    load. Verified prices are at most five cents off.
    """
    events = table(spark, sf_dir, "events")
    cells = events.groupBy(F.col("event_type").alias("zone"), F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("hour")).agg(*[F.floor(F.avg(c)).alias(n) for n, c in (("k", _k()), ("v", F.col("value")), ("u", F.col("user_id")))])
    cells = stored(cells, "cells")
    span = cells.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")).withColumn("hour", F.explode(F.sequence(F.lit(1), hours_in_local_day(F.col("day")))))
    grid = grid.select("day", "hour", F.posexplode(F.array(*[F.lit(t) for t in TYPES])).alias("z", "zone"))
    rows = grid.join(cells, ["zone", "day", "hour"], "left").fillna(0, ["k", "v", "u"]).withColumn("d", F.datediff("day", F.lit(FIRST_DAY).cast("date")))
    mixed = lambda d, h, z, more, n: F.pmod(F.col("d") * d + F.col("hour") * h + F.col("z") * z + F.col(more), F.lit(n)).cast("double")
    rows = rows.withColumns({"price_da": 20 + mixed(31, 17, 7, "k", 100) * 0.6, "noise": (mixed(13, 29, 11, "v", 41) - 20) / 10, "more": mixed(7, 5, 3, "u", 51)})
    da, peak = F.col("price_da"), hour_block(clock_hour(F.col("day"), F.col("hour"))) == "peak"
    rows = rows.withColumn("load_forecast_mw", 500 + da * da * 0.05 + F.col("more"))
    rows = rows.withColumn("price_rt", da + da * da * F.when(peak, 0.015).otherwise(0.01) + F.col("load_forecast_mw") * 0.02 + F.col("noise"))
    rows = stored(rows.select("zone", "day", "hour", "price_da", "price_rt", "load_forecast_mw"), "hours")
    off = (F.pmod(F.datediff("day", F.lit(FIRST_DAY).cast("date")) + F.col("hour"), F.lit(3)) - 1) * 0.05
    published = feeds.published_rows(rows, rows).withColumn("seq", _seq())
    revised = feeds.verified_rows(rows, rows.withColumn("price_rt", F.col("price_rt") + off)).withColumn("seq", _seq())
    return ReleaseFeeds(published, revised, rows.select(F.col("zone").alias("hub"), "day", "hour", "load_forecast_mw"))


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows in which every reason occurs."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        n.alias("event_id"), F.when(n % 71 != 0, F.col("event_type")).alias("hub"), F.when(n % 73 != 0, F.to_date("ts")).alias("day"),
        (F.hour("ts") + n % 3).cast("double").alias("hour"), F.when(n % 79 != 0, _k()).alias("price_da"), F.when(n % 5 != 0, F.col("value")).alias("price_rt"),
        F.when(n % 97 == 0, "USD/kWh").when(n % 97 != 1, feeds.UNIT).alias("unit"), F.when(n % 89 == 0, "draft").when(n % 2 == 0, "preliminary").otherwise("verified").alias("status"),
    )


def contract_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as JSON text, numbers as numbers; some with a key more or less, or a value of another form or type."""
    n, rows = F.col("event_id") % 83, contract_rows(spark, sf_dir)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    plain = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    day, da = F.col("day").cast("string"), F.col("price_da").cast("string")
    odd = {
        "hub": {12: F.lit("7"), 13: F.lit('["view"]')},
        "day": {
            3: quoted(F.concat(day, F.lit(" 06:30:00"))), 4: quoted(F.concat(day, F.lit(" 00:00:00"))), 10: F.lit('"2026-01"'), 11: F.lit('"2026"'), 14: F.lit("1704067200"), 15: quoted(F.concat(day, F.lit("T00:00Z"))),
            16: F.lit("true"), 24: F.lit('"2024-02-30"'),
        },
        "hour": {5: F.lit("2.5"), 6: F.lit('"two"'), 17: F.lit("true"), 18: quoted(F.col("hour").cast("string")), 19: F.lit('"2.5"'), 25: F.lit('{"is": 3}')},
        "price_da": {7: F.lit('"NaN"'), 20: F.lit('"30.5d"'), 21: quoted(da), 22: F.lit("true")},
        "price_rt": {8: F.lit('"n/a"'), 23: F.lit("[1]")},
    }
    plains = {"hub": quoted(F.col("hub")), "day": quoted(day), "hour": plain(F.col("hour").cast("int")), "price_da": plain(F.col("price_da")), "price_rt": plain(F.col("price_rt")), "unit": quoted(F.col("unit")), "status": quoted(F.col("status")), "note": F.lit('"x"')}
    gone = {"unit": n == 0, "price_rt": n == 1, "hour": n == 2, "note": n != 9}
    parts = []
    for name, value in plains.items():
        for k, other in odd.get(name, {}).items():
            value = F.when(n == k, other).otherwise(value)
        part = F.concat(F.lit(f'"{name}": '), value)
        parts.append(F.when(~gone[name], part) if name in gone else part)
    return rows.select("event_id", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("payload"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders: keys that disagree by nature, and the lines of every tenth order published twice."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey").withColumn("copy", F.lit(0))
    return rows.unionByName(rows.filter("l_orderkey % 10 = 0").withColumn("copy", F.lit(1)))


DUPLICATE_KEY, DUPLICATE_VALUES = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"]
DUPLICATE_ORDER = ["copy", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@dataclass(frozen=True)
class Feeds:
    """What a gate reads, stored: each of events' aggregates is made once, whoever reads it."""

    preliminary: DataFrame
    hourly: DataFrame


def stored_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """Preliminary rows, and the same hours with the publisher's own price. Events are read twice: by interval, and by hour."""
    events = table(spark, sf_dir, "events")
    hours = events.groupBy(F.col("event_type").alias("zone"), F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("hour"))
    cells = stored(hours.agg(F.avg(_k()).alias("price_da"), F.avg("value").alias("price_rt")), "cells")
    rows = feeds.published_rows(cells, real_time(spark, sf_dir)).withColumn("seq", _seq())
    return Feeds(stored(rows, "preliminary"), feeds.published_rows(cells, cells))


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders, 1995 to 2001, among them days of 23 and 25 hours."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


def calendar_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar_days(spark, sf_dir)
    return days.select("day", F.explode(F.sequence(F.lit(1), hours_in_local_day(F.col("day")))).alias("position"))


def clock_stamps(spark: SparkSession, sf_dir: str, minutes: list[int]) -> DataFrame:
    """What a publisher stamps on those days: clock hour-endings in order, with the minutes of each hour."""
    rows = calendar_hours(spark, sf_dir).withColumn("n", hours_in_local_day(F.col("day")))
    p = F.col("position")
    clock = F.when((F.col("n") == 25) & (p >= 3), p - 1).when((F.col("n") == 23) & (p >= 2), p + 1).otherwise(p)
    rows = rows.withColumns({"clock": clock, "minute": F.explode(F.array(*[F.lit(m) for m in minutes]))})
    return rows.withColumns({"zone": F.lit("all"), "seq": p * 100 + F.col("minute")}).drop("n")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with two predictors: y, x1, x2, block, hub and a key."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(key.alias("key"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("p_retailprice").alias("x2"), F.col("l_returnflag").alias("block"), F.col("l_linestatus").alias("hub"))


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as runs of their own by year of shipping."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(F.year("l_shipdate").cast("string").alias("run_id"), key.alias("key"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("p_retailprice").alias("x2"), F.col("l_returnflag").alias("block"), F.col("l_linestatus").alias("hub"))


def daily_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions of value by k, a series for each type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("day"), F.col("value").alias("y"), _k().alias("p"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
