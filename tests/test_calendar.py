import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricegate.functions import calendar as cal
from pricegate.functions.numbers import cents, fixed

FALL, SPRING, PLAIN = dt.date(2025, 11, 2), dt.date(2026, 3, 8), dt.date(2026, 1, 15)


def days(spark, *which):
    return spark.createDataFrame([(x,) for x in which], "day date")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_hours_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = days(spark, FALL, SPRING, PLAIN).select("day", cal.hours_in_local_day(F.col("day")), cal.intervals_in_local_day(F.col("day"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r[0]: (r[1], r[2]) for r in got} == {FALL: (25, 300), SPRING: (23, 276), PLAIN: (24, 288)}


def test_round_trip_of_every_hour(spark):
    span = spark.sql("SELECT explode(sequence(date'2025-10-01', date'2026-03-20')) AS day")
    hours = span.withColumn("hour", F.explode(F.sequence(F.lit(1), cal.hours_in_local_day(F.col("day"))))).withColumn("utc", cal.hour_ending_utc(F.col("day"), F.col("hour")))
    day, hour = cal.utc_to_local_day_hour(F.col("utc"))
    assert hours.filter((day != F.col("day")) | (hour != F.col("hour"))).count() == 0
    assert hours.select("utc").distinct().count() == hours.count() == 171 * 24


def test_labels_and_refused_hours(spark):
    pairs = [(FALL, h) for h in (1, 2, 3, 4, 25)] + [(SPRING, h) for h in (1, 2, 3, 24)] + [(PLAIN, 25), (PLAIN, 24)]
    df = spark.createDataFrame(pairs, "day date, hour int")
    got = [tuple(r) for r in df.select(cal.hour_ending_label(F.col("day"), F.col("hour")), cal.hour_ending_utc(F.col("day"), F.col("hour")).isNull()).collect()]
    assert got == [("01", False), ("02", False), ("02*", False), ("03", False), ("24", False), ("01", False), ("03", False), ("04", False), (None, True), (None, True), ("24", False)]


def placed(spark, day, stamps):
    df = spark.createDataFrame([("z", day, c, m, i) for i, (c, m) in enumerate(stamps)], "zone string, day date, clock int, minute int, seq long").repartition(3)
    return [r["hour"] for r in cal.with_positions(df, ["zone"], "day", "clock", "minute", ["seq"]).orderBy("seq").collect()]


def test_positions(spark):
    assert placed(spark, FALL, [(c, 0) for c in [1, 2, 2, *range(3, 25)]]) == list(range(1, 26))
    assert placed(spark, SPRING, [(c, 0) for c in [1, *range(3, 25)]]) == list(range(1, 24))
    five = [(c, m) for c in (1, 2, 2, 3) for m in range(5, 65, 5)]
    assert placed(spark, FALL, five) == [h for h in (1, 2, 3, 4) for _ in range(12)]
    assert placed(spark, FALL, [(2, 20), (2, 40), (2, 60)]) == [2, 3, 3]


def test_blocks_and_numbers(spark):
    got = spark.range(1, 25).select("id", cal.hour_block(F.col("id")).alias("b")).collect()
    assert {r["b"]: sum(x["b"] == r["b"] for x in got) for r in got} == {"peak": 8, "shoulder": 7, "off_peak": 9}
    x = spark.createDataFrame([(1.005,), (-2.5,), (None,), (0.1 + 0.2,)], "x double")
    assert [r[0] for r in x.select(cents(F.col("x"))).collect()] == [1.0, -2.5, None, 0.3]
    assert [r[0] for r in x.select(fixed(F.col("x"))).collect()] == [1.005, -2.5, None, 0.3]
