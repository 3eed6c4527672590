"""Retries and conflicts, hour counts on the full grid, and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import ZONE, hours_in_local_day

KEY, VALUES = ["hub", "day", "hour"], ["price_da", "price_rt", "status"]


def exact_rows(rows: DataFrame, key: list[str] = KEY, values: list[str] = VALUES, order: list[str] | None = None) -> DataFrame:
    """One row for each different (key, values): copies, key_rows (different values of the key), place (1: first published).

    Exact copies collapse in partial aggregates first, so a key that is sent over and over
    costs its different values only. ``order``: publication order; ties are settled by values.
    """
    order = order or ["seq"]
    first = rows.groupBy(*key, *values).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("copies"))
    of_key = Window.partitionBy(*key)
    place = F.row_number().over(of_key.orderBy("__first", *values))
    return first.withColumns({"place": place, "key_rows": F.count("*").over(of_key)})


def split_duplicates(rows: DataFrame, key: list[str] = KEY, values: list[str] = VALUES, order: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, conflicts, counts): the first row of each key; all different rows of keys that disagree; rows, retries, conflicting_keys.

    A preliminary and a verified row of one key disagree, as the status is a value.
    """
    exact = exact_rows(rows, key, values, order)
    clean = exact.filter("place = 1").select(*key, *values)
    conflicts = exact.filter("key_rows > 1").select(*key, *values, "copies", "place")
    n = F.coalesce(F.sum("copies"), F.lit(0))
    clash = F.count(F.when((F.col("key_rows") > 1) & (F.col("place") == 1), 1))
    counts = exact.agg(n.alias("rows"), (n - F.count("*")).alias("retries"), clash.alias("conflicting_keys"))
    return clean, conflicts, counts


def interval_counts(rows: DataFrame, hubs: list[str] | DataFrame, zone: str = ZONE, hub: str = "hub", day: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """hours_seen, hours_expected and ok of every hub on every day between the first and the last, of each run where ``by`` names its columns."""
    spark = rows.sparkSession
    hubs = spark.createDataFrame([(h,) for h in hubs], f"{hub} string") if isinstance(hubs, list) else hubs
    span = rows.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a is not null")
    days = span.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    grid = days.crossJoin(hubs)  # all that the calendar expects, so a row for each hub and day
    seen = rows.groupBy(*by, hub, day).agg(F.count("*").alias("hours_seen"))
    out = grid.join(seen, [*by, hub, day], "left").withColumn("hours_expected", hours_in_local_day(F.col(day), zone))
    out = out.withColumn("hours_seen", F.coalesce("hours_seen", F.lit(0)))
    return out.select(*by, hub, day, "hours_seen", "hours_expected", (F.col("hours_seen") == F.col("hours_expected")).alias("ok"))


def wrong_days(counts: DataFrame) -> DataFrame:
    return counts.filter("not ok")


def latest_revisions(revisions: DataFrame, key: list[str] = KEY, values: list[str] = VALUES, order: list[str] | None = None) -> DataFrame:
    """The last published revision of each key, nulls and all."""
    newest = F.max_by(F.struct(*values), F.struct(*(order or ["seq"]))).alias("__new")
    return revisions.groupBy(*key).agg(newest)


def apply_revisions(rows: DataFrame, revisions: DataFrame, key: list[str] = KEY, values: list[str] = VALUES, order: list[str] | None = None) -> DataFrame:
    """Rows whose key was revised take the revision's values, nulls too; others stay; unmatched revisions do nothing."""
    joined = rows.join(latest_revisions(revisions, key, values, order), key, "left")
    new = {v: F.when(F.col("__new").isNotNull(), F.col("__new")[v]).otherwise(F.col(v)) for v in values}
    return joined.withColumns(new).select(*rows.columns)


def ghost_revisions(rows: DataFrame, revisions: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Revisions of keys that were never published."""
    return revisions.join(rows.select(*key), key, "left_anti")


def revision_gap(before: DataFrame, after: DataFrame, tolerance: float = 2.0, key: list[str] = KEY, value: str = "price_rt", by: str = "hub") -> DataFrame:
    """share_off (gaps above the tolerance), mean_abs and n, by hub and, with a null hub, over all.

    Keys where a price is null are left out; without any the overall row has zeros.
    """
    a, b = before.select(*dict.fromkeys([*key, by]), F.col(value).alias("__a")), after.select(*key, F.col(value).alias("__b"))
    gap = F.abs(F.col("__b") - F.col("__a"))
    both = a.join(b, key).filter(gap.isNotNull())
    sums = both.groupBy(by).agg(F.sum((gap > tolerance).cast("long")).alias("off"), F.sum(gap).alias("gap"), F.count("*").alias("n"))
    total = sums.agg(F.max(F.lit(None).cast(sums.schema[by].dataType)).alias(by), F.sum("off").alias("off"), F.sum("gap").alias("gap"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    return sums.unionByName(total).select(by, share("off").alias("share_off"), share("gap").alias("mean_abs"), "n")
