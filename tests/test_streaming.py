import datetime as dt

from pricegate.streaming import contract

SCHEMA = "hub string, day date, hour int, price_da double, price_rt double, unit string, status string, seq long, arrived timestamp"


def test_contract_and_retries_on_a_stream(spark, tmp_path):
    at = dt.datetime(2026, 1, 15, 12)
    good = ("WEST", dt.date(2026, 1, 15), 1, 1.0, 1.0, "USD/MWh", "preliminary", 1, at)
    bad = ("PJM", *good[1:])
    spark.createDataFrame([good, good, bad], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = contract.marked(contract.without_retries(stream)).writeStream.format("memory").queryName("marked").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["hub"], r["reason"]) for r in spark.table("marked").collect()) == [("PJM", "unknown_hub"), ("WEST", None)]


def test_revisions_as_a_sink(spark, tmp_path):
    at = dt.datetime(2026, 1, 15, 12)
    row = ("WEST", dt.date(2026, 1, 15), 1, 1.0, 1.0, "USD/MWh", "preliminary", 1, at)
    spark.createDataFrame([row], SCHEMA).drop("arrived").write.partitionBy("day").parquet(f"{tmp_path}/rows")
    spark.createDataFrame([(*row[:3], 2.0, 2.0, "USD/MWh", "verified", 1, at)], SCHEMA).write.parquet(f"{tmp_path}/rev")
    q = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/rev").writeStream.foreachBatch(contract.revise(f"{tmp_path}/rows", f"{tmp_path}/log")).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/rows").first()["status"] == "verified"


def test_batches_build_on_one_another(spark, tmp_path):
    """Hours revised by an early batch stay revised; files of days that no batch touches stay; a batch that comes again changes nothing."""
    at = dt.datetime(2026, 1, 15, 12)
    row = lambda hour, price, status, day=15: ("WEST", dt.date(2026, 1, day), hour, price, price, "USD/MWh", status, 1, at)
    spark.createDataFrame([row(1, 1.0, "preliminary"), row(2, 1.0, "preliminary"), row(1, 5.0, "preliminary", 16)], SCHEMA).drop("arrived").write.partitionBy("day").parquet(f"{tmp_path}/rows")
    names = lambda day: sorted(p.name for p in (tmp_path / "rows" / f"day=2026-01-{day}").glob("*.parquet"))
    run = contract.revise(f"{tmp_path}/rows", f"{tmp_path}/log")
    batch = lambda hour, price: spark.createDataFrame([row(hour, price, "verified")], SCHEMA)
    untouched, touched = names(16), names(15)
    run(batch(1, 2.0), 0)
    run(batch(2, 3.0), 1)
    assert names(16) == untouched and names(15) != touched
    done = names(15)
    run(batch(1, 9.0), 0)
    run(batch(2, 9.0), 1)
    assert names(15) == done
    got = sorted((r["day"].day, r["hour"], r["price_rt"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [(15, 1, 2.0, "verified"), (15, 2, 3.0, "verified"), (16, 1, 5.0, "preliminary")]
