"""Tables of one layout meet without an exchange, with the results they have without it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricegate.operators import features, reconcile
from pricegate.sources import folders, layout

D = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    hours = spark.range(0, 4000).select(F.format_string("h%d", F.col("id") % 7).alias("hub"), F.date_add(F.lit(D), ((F.col("id") / 7).cast("int") % 20)).alias("day"), (F.col("id") % 24 + 1).cast("int").alias("hour"), (F.col("id") % 50).cast("double").alias("price_da"), (F.col("id") % 53).cast("double").alias("price_rt"), F.lit("preliminary").alias("status"), F.col("id").alias("seq"))
    rows = hours.dropDuplicates(["hub", "day", "hour"])
    revisions = rows.filter("seq % 3 = 0").withColumns({"price_rt": F.col("price_rt") + 1, "status": F.lit("verified")})
    forecasts = rows.select("hub", "day", "hour", (F.col("seq") * 2.0).alias("load_forecast_mw"))
    plain = {"rows": rows.cache(), "revisions": revisions, "forecasts": forecasts}
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield plain, {k: layout.write_layout(df, f"layout_{k}", 4) for k, df in plain.items()}
    for k, v in old.items():
        spark.conf.set(k, v)
    for k in plain:
        spark.sql(f"DROP TABLE layout_{k}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


JOBS = {
    "preliminary": lambda t: t["rows"].drop("price_rt").join(t["revisions"].select("hub", "day", "hour", "price_rt"), reconcile.KEY, "left"),
    "revisions": lambda t: reconcile.apply_revisions(t["rows"], t["revisions"]),
    "ghosts": lambda t: reconcile.ghost_revisions(t["rows"], t["revisions"]),
    "spread": lambda t: features.daily_spread(t["rows"]),
    "targets": lambda t: t["rows"].filter("price_rt is not null").join(t["forecasts"], reconcile.KEY),
    "duplicates": lambda t: reconcile.exact_rows(t["rows"]),
}


@pytest.mark.parametrize("name", JOBS)
def test_no_exchange(tables, name):
    plain, laid = tables
    assert exchanges(JOBS[name](plain)) > 0 and exchanges(JOBS[name](laid)) == 0
    columns = sorted(JOBS[name](plain).columns)
    same = [sorted(map(str, JOBS[name](t).select(columns).collect())) for t in (plain, laid)]
    assert same[0] == same[1]


@pytest.mark.parametrize(
    ("path", "uri"),
    [("/a/b", "file:///a/b"), ("file:/a/b", "file:///a/b"), ("file:///a b", "file:///a b"), ("s3a://bucket/k=1/x", "s3://bucket/k=1/x"), ("hdfs://host:8020/a", "hdfs://host:8020/a"), ("abfss://c@h/a", "abfss://c@h/a"), ("/a:b/c", "file:///a:b/c"), ("gcs://b/a", "gs://b/a")],
)
def test_paths_for_tasks(path, uri):
    assert folders.for_tasks(path) == uri


def test_unknown_scheme():
    with pytest.raises(ValueError, match="wasbs"):
        folders.for_tasks("wasbs://c@h/a")


def test_gap_moves_sums_only(tables):
    plain, laid = tables
    gap = lambda t: reconcile.revision_gap(t["rows"], t["revisions"], 0.5)
    assert exchanges(gap(laid)) < exchanges(gap(plain))
    assert sorted(map(str, gap(plain).collect())) == sorted(map(str, gap(laid).collect()))
