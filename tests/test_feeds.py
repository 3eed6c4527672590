import datetime as dt
import gzip
import hashlib
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from pricegate.operators import contract, reconcile
from pricegate.functions.numbers import cents
from pricegate.sources import feeds, files

D = dt.date(2026, 1, 15)
FALL = dt.date(2025, 11, 2)


def stamps(spark, day, times, price=10.0):
    base = dt.datetime.combine(day, dt.time())
    data = [(day, (base + dt.timedelta(minutes=m)).strftime("%m/%d/%Y %H:%M:%S"), "WEST", 1, p if isinstance(p, (float, type(None))) else price, 0.0, 0.0, i) for i, (m, p) in enumerate(times)]
    return spark.createDataFrame(data, feeds.PRICES + ", seq long")


def test_integration_weighs_by_length(spark):
    rows = stamps(spark, D, [(5, 10.0), (20, 20.0), (60, 30.0), (60, 90.0), (65, None), (1440, 7.0)])
    got = {r["hour"]: (r["price_rt"], r["intervals"]) for r in feeds.integrate_intervals(rows).collect()}
    assert got[1] == ((5 * 10 + 15 * 20 + 40 * 30 + 5 * 90) / 65, 4)  # a repeated stamp counts 5 minutes
    assert got[2] == (0.0, 1)  # a null price keeps its weight
    assert got[24] == (7.0, 1)  # midnight closes the day
    again = {r["hour"]: (r["price_rt"], r["intervals"]) for r in feeds.integrate_intervals(rows.repartition(5, "lbmp")).collect()}
    assert again == got


def test_hourly_positions_on_the_long_day(spark):
    clocks = [0, 1, 1, *range(2, 24)]
    rows = spark.createDataFrame([(FALL, f"11/02/2025 {c:02d}:00", "WEST", 1, 1.0, 0.0, 0.0, i) for i, c in enumerate(clocks)], feeds.PRICES + ", seq long")
    assert [r["hour"] for r in feeds.hourly_positions(rows).orderBy("seq").collect()] == list(range(1, 26))


def test_vintage_keeps_the_day_before(spark):
    wide = spark.createDataFrame([(D, D - dt.timedelta(days=k), c, c, 5.0, "x" if c == 2 else "7") for k in (1, 2) for c in (1, 2)], "day date, file_day date, clock int, seq int, West double, `Hud Vl` string")
    got = sorted((r["hub"], r["hour"], r["load_forecast_mw"]) for r in feeds.forecast_vintage(wide, ["West", "Hud Vl"]).collect())
    assert got == [("HUD VL", 1, 7.0), ("WEST", 1, 5.0), ("WEST", 2, 5.0)]


def test_hubs_and_joins(spark):
    zones = spark.createDataFrame([("WEST",), ("PJM",)], "zone string")
    assert [r[0] for r in feeds.only_hubs(zones, feeds.HUBS).collect()] == ["WEST"]
    assert [r[0] for r in feeds.only_hubs(zones, spark.createDataFrame([("PJM",)], "zone string")).collect()] == ["PJM"]
    da = spark.createDataFrame([("WEST", D, 1, 10.004), ("WEST", D, 2, 11.0)], "zone string, day date, hour int, price_da double")
    rt = spark.createDataFrame([("WEST", D, 1, 9.996), ("WEST", D, 3, 1.0)], "zone string, day date, hour int, price_rt double")
    assert sorted((r["hour"], r["price_da"], r["price_rt"], r["status"]) for r in feeds.published_rows(da, rt).collect()) == [(1, 10.0, 10.0, "preliminary"), (2, 11.0, None, "preliminary")]
    assert [(r["hour"], r["status"]) for r in feeds.verified_rows(da, rt).collect()] == [(1, "verified")]


def test_daily_files(spark, tmp_path):
    for day, line in (("20260115", "a,WEST,1,2.5,0,0"), ("20260116", "b,WEST,1,3.5,0,0"), ("20260201", "c,WEST,1,4.5,0,0")):
        with gzip.open(tmp_path / f"{day}zone.csv.gz", "wt") as f:
            f.write('"Time Stamp","Name","PTID","LBMP ($/MWHr)","Marginal Cost Losses ($/MWHr)","Marginal Cost Congestion ($/MWHr)"\n' + line + "\n")
    (tmp_path / "notadayzone.csv").write_text('"Time Stamp","Name","PTID","LBMP","Losses","Congestion"\nz,WEST,1,9,0,0\n')
    rows = files.read_daily_files(spark, [str(tmp_path)], "2026-01-15", "2026-01-31")
    assert rows.columns == ["file_day", "seq", "time_stamp", "time_zone", "zone", "ptid", "lbmp", "losses", "congestion"]
    assert sorted((str(r["file_day"]), r["time_stamp"], r["lbmp"]) for r in rows.collect()) == [("2026-01-15", "a", "2.5"), ("2026-01-16", "b", "3.5")]
    old = files.file_manifest(spark, f"{tmp_path}/*.gz")
    assert old.count() == 3 and files.manifest_differences(old, old).count() == 0
    less = old.filter("file <> '20260115zone.csv.gz'").withColumn("bytes", F.when(F.col("file").startswith("20260116"), 1).otherwise(F.col("bytes")))
    assert sorted(tuple(r) for r in files.manifest_differences(old, less).collect()) == [("20260115zone.csv.gz", "missing"), ("20260116zone.csv.gz", "changed")]
    files.write_days(rows.withColumnRenamed("file_day", "day"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").filter("day = '2026-01-16'").count() == 1
    assert files.table_manifest({"rows": rows}).first()["rows"] == 2
    files.write_report(old, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 3


def test_daily_files_in_archives_keep_their_order_and_headers(spark, tmp_path):
    """Zip members beside a larger plain file; each with a header of its own; members and files in order of name."""
    with zipfile.ZipFile(tmp_path / "202401zone_csv.zip", "w") as z:
        z.writestr("20240103zone.csv", " Name ,Time Stamp,LBMP ($/MWHr),PTID\nWEST,c1,3.5,7\nNORTH,c2,4.5,8\n")
        z.writestr("20240102zone.csv", "Time Stamp,Time Zone,Name,PTID,LBMP ($/MWHr)\nb1,EST,WEST,7,2.5\n")
        z.writestr("notes.txt", "x")
    (tmp_path / "20240104zone.csv").write_text("PTID,Name,Time Stamp,LBMP\n" + "".join(f"7,WEST,d{k},{k}\n" for k in range(5000)))
    rows = files.read_daily_files(spark, [str(tmp_path)], "2024-01-02", "2024-01-31").orderBy("seq").collect()
    assert [r["time_stamp"] for r in rows[:5000]] == [f"d{k}" for k in range(5000)]  # the file's name comes before the archive's
    assert [(str(r["file_day"]), r["time_stamp"], r["time_zone"], r["zone"], r["ptid"], r["lbmp"]) for r in rows[5000:]] == [("2024-01-02", "b1", "EST", "WEST", "7", "2.5"), ("2024-01-03", "c1", None, "WEST", "7", "3.5"), ("2024-01-03", "c2", None, "NORTH", "8", "4.5")]


def test_large_plain_files_are_split(spark, tmp_path):
    """A plain file in several parts, beside one with the same header and one with another: lines in order all the same."""
    (tmp_path / "20240102zone.csv").write_text("Name,Time Stamp,LBMP\n" + "".join(f"WEST,b{k},{k}\n" for k in range(20_000)))
    (tmp_path / "20240101zone.csv").write_text("Name,Time Stamp,LBMP\nWEST,a0,\nWEST\n")
    (tmp_path / "20240103zone.csv").write_text("\ufeffTime Stamp,Name,Other,LBMP\nc0,NORTH,z,1\n")
    (tmp_path / "20240104zone.csv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = files.read_daily_files(spark, [str(tmp_path)], "2024-01-01", "2024-01-31")
        assert rows.rdd.getNumPartitions() > 1
        got = rows.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["time_stamp"] for r in got] == ["a0", None, *[f"b{k}" for k in range(20_000)], "c0"] and got[0]["lbmp"] is None and got[-1]["zone"] == "NORTH"


def test_members_are_streamed(tmp_path):
    """A member of 250 MB is read by a process that may hold little more than Python and its libraries."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("20240102zone.csv", "w") as f:
        f.write(b"Name,Time Stamp,LBMP\n")
        for _ in range(250):
            f.write(b"WEST,01/02/2024 00:05:00,12.5\n" * 34_000)
    code = (
        "import resource, datetime as dt; from pricegate.sources import files\n"
        "n = 0\n"
        f"with files._opened('file:{tmp_path}/a.zip') as raw:\n"
        "    for k, b in enumerate(files._member_lines('a.zip', raw, dt.date(2024, 1, 1), dt.date(2024, 1, 31))):\n"
        "        n += b.num_rows\n"
        "        if k == 3: start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()
    assert int(out[0]) == 250 * 34_000 and int(out[1]) < 50_000  # kB more than after the first pieces


def test_verified_reads(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    manifest = files.file_manifest(spark, f"{tmp_path}/t/*.parquet").cache()
    assert manifest.count() == 3 and files.read_verified(spark, f"{tmp_path}/t", manifest).count() == 100
    parts = sorted((tmp_path / "t").glob("*.parquet"))
    assert {r["sha256"] for r in manifest.collect()} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in parts}
    whole = parts[0].read_bytes()
    parts[0].write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    with pytest.raises(ValueError, match="changed"):
        files.read_verified(spark, f"{tmp_path}/t", manifest)
    parts[0].unlink()
    with pytest.raises(ValueError, match="missing"):
        files.read_verified(spark, f"{tmp_path}/t", manifest)


def test_price_tables(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k, n in ((1, 1), (2, 3000), (3, 1)):
        (tmp_path / "t" / f"{k}.csv").write_text("file_day,time_stamp,zone,ptid,lbmp,losses,congestion\n" + "".join(f"2024-01-0{k},x{i},WEST,1,{i}.5,0,0\n" for i in range(n)))
    rows = feeds.read_prices(spark, f"{tmp_path}/t").orderBy("seq").collect()
    assert [(r["file_day"].day, r["time_stamp"]) for r in rows] == [(k, f"x{i}") for k, n in ((1, 1), (2, 3000), (3, 1)) for i in range(n)]
    assert feeds.read_prices(spark, f"{tmp_path}/none", required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        feeds.read_prices(spark, f"{tmp_path}/none")


def test_snapshot_manifest(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/a")
    (tmp_path / "raw.zip").write_bytes(b"abc")
    row = files.snapshot_manifest(spark, {"a": f"{tmp_path}/a"}, f"{tmp_path}/*.zip", "2024-01-01", "2024-01-31", ["u1"]).first()
    part = next((tmp_path / "a").glob("*.parquet")).read_bytes()
    digest = hashlib.sha256(hashlib.sha256(part).hexdigest().encode()).hexdigest()
    assert [tuple(t) for t in row["tables"]] == [("a", 5, "id", digest)] and [tuple(f) for f in row["raw_files"]] == [("raw.zip", 3, hashlib.sha256(b"abc").hexdigest())]
    assert row["missing"] == ["u1"] and str(row["window"]["start"]) == "2024-01-01"


def test_cents_are_pythons(spark):
    some = [2.675, 0.285, 1.005, 10.125, 10.135, -2.675, 0.0, 4999.995, 31.2049999, *[k / 1000 for k in range(5, 4000, 10)]]
    got = spark.createDataFrame([(v,) for v in some], "v double").select("v", cents(F.col("v")).alias("c")).collect()
    assert all(r["c"] == round(r["v"], 2) for r in got)
    assert spark.createDataFrame([(2.675 + 1e-13, None)], "v double, n double").select(cents(F.col("v")), cents(F.col("n"))).first() == (2.67, None)


BASE = {"hub": "N.Y.C.", "day": "2026-01-15", "hour": 1, "price_da": 30.0, "price_rt": 32.0, "unit": "USD/MWh", "status": "preliminary"}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, None), ({"price_rt": None}, None), ({"price_rt": "-50"}, None), ({"hour": "2.0"}, None), ({"hour": 2.0}, None), ({"day": "2026-01-15 00:00:00"}, None), ({"day": "2026-01-15T00:00Z"}, None), ({"price_da": " 3_0.5 "}, None), ({"hour": True}, None), ({"price_da": True}, None),
        ({"unit": "USD/kWh"}, "unit_not_usd_mwh"), ({"unit": None}, "unit_not_usd_mwh"), ({"unit": 3}, "unit_not_usd_mwh"), ({"status": "draft"}, "unknown_status"), ({"status": ["verified"]}, "unknown_status"), ({"hub": "PJM"}, "unknown_hub"),
        ({"hub": None}, "bad_type"), ({"hub": 7}, "bad_type"), ({"hub": ["WEST"]}, "bad_type"), ({"hub": True}, "bad_type"),
        ({"hour": "25"}, "hour_beyond_day"), ({"hour": "25", "day": "2025-11-02"}, None), ({"hour": "0"}, "hour_before_day"), ({"hour": False}, "hour_before_day"), ({"hour": "26", "day": "2025-11-02"}, "hour_beyond_day"), ({"hour": 2.5}, "hour_beyond_day"), ({"hour": "2.5"}, "bad_type"),
        ({"hour": "x"}, "bad_type"), ({"hour": [1]}, "bad_type"), ({"hour": {"a": 1}}, "bad_type"), ({"hour": 10**22}, "hour_beyond_day"),
        ({"price_da": "9000"}, "price_out_of_range"), ({"price_da": "NaN"}, "price_out_of_range"), ({"price_da": "-inf"}, "price_out_of_range"), ({"price_da": None}, "bad_type"), ({"price_da": "30.5d"}, "bad_type"), ({"price_da": "0x10"}, "bad_type"), ({"price_da": ""}, "bad_type"), ({"price_rt": [1.0]}, "bad_type"),
        ({"day": "2026-01-15 06:00:00"}, "date_from_datetime_inexact"), ({"day": "2026-01-15T00:00:00.5"}, "date_from_datetime_inexact"), ({"day": "soon"}, "bad_type"), ({"day": "2026-01"}, "bad_type"), ({"day": "2026"}, "date_from_datetime_inexact"), ({"day": 1768435200}, None), ({"day": "1768435200"}, None),
        ({"day": 1768435200000}, None), ({"day": 1768435201}, "date_from_datetime_inexact"), ({"day": "2026-02-30"}, "bad_type"), ({"day": "2026-01-15 25:00"}, "bad_type"), ({"day": True}, "bad_type"), ({"day": ["2026-01-15"]}, "bad_type"), ({"day": None}, "bad_type"),
        ({"note": "x"}, "unexpected_field"), ({"hub": ...}, "missing_field"), ({"price_rt": ...}, None), ({"hour": "0", "unit": "x", "note": "x"}, "hour_before_day"), ({"note": "x", "hub": "PJM"}, "unexpected_field"),
    ],
)
def test_contract_payload(spark, change, expected):
    payload = json.dumps({k: v for k, v in (BASE | change).items() if v is not ...})
    df = spark.createDataFrame([(payload,)], "m string")
    assert contract.with_reason(df, payload="m").first()["reason"] == expected


def test_no_payload(spark):
    df = spark.createDataFrame([(t,) for t in (None, "", "[1]", "3", "{", '{"hub": "WEST", "hub": "WEST"}')], "m string")
    assert {r["reason"] for r in contract.with_reason(df, payload="m").collect()} == {"bad_type"}
    good = contract.with_reason(spark.createDataFrame([(json.dumps(BASE | {"hour": "2.0", "price_rt": None, "day": "2026-01-15T00:00"}),)], "m string"), payload="m").select(*contract.typed_payload()).first()
    assert tuple(good) == ("N.Y.C.", dt.date(2026, 1, 15), 2, 30.0, None, "USD/MWh", "preliminary")


def published(spark, data):
    return spark.createDataFrame([(h, D, hour, da, rt, "USD/MWh", st, s) for h, hour, da, rt, st, s in data], "hub string, day date, hour int, price_da double, price_rt double, unit string, status string, seq long")


def test_typed_contract_keeps_every_row(spark):
    rows = published(spark, [("WEST", 1, 1.0, None, "preliminary", 1), ("WEST", 25, 1.0, 1.0, "preliminary", 2), ("X", 1, 1.0, 1.0, "verified", 3), (None, 1, None, None, None, 4)])
    good, bad = contract.validate(rows)
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["bad_type", "hour_beyond_day", "unknown_hub"]
    rate = contract.quarantine_rate(contract.with_reason(rows)).first()
    assert (rate["published"], rate["quarantined"], rate["rate"]) == (4, 3, 0.75)


def test_duplicates(spark):
    day = [("WEST", h, 1.0 * h, None if h == 3 else 2.0, "preliminary", h) for h in range(1, 25)]
    again = [(h, hour, da, 5.0 if hour == 17 else rt, st, s + 100) for h, hour, da, rt, st, s in day]
    clean, conflicts, counts = reconcile.split_duplicates(published(spark, day + again).repartition(7))
    assert tuple(counts.first()) == (48, 23, 1)
    assert clean.count() == 24 and clean.filter("hour = 17").first()["price_rt"] == 2.0
    assert conflicts.count() == 2
    empty = published(spark, [])
    assert tuple(reconcile.split_duplicates(empty)[2].first()) == (0, 0, 0)
    two = published(spark, [("WEST", 1, 1.0, 1.0, "preliminary", 1), ("WEST", 1, 1.0, 1.0, "verified", 2)])
    assert reconcile.split_duplicates(two)[2].first()["conflicting_keys"] == 1


def test_counts_on_the_grid(spark):
    rows = published(spark, [("WEST", h, 1.0, 1.0, "preliminary", h) for h in range(1, 24)])
    got = {r["hub"]: (r["hours_seen"], r["hours_expected"], r["ok"]) for r in reconcile.interval_counts(rows, ["WEST", "NORTH"]).collect()}
    assert got == {"WEST": (23, 24, False), "NORTH": (0, 24, False)}
    assert reconcile.interval_counts(published(spark, []), ["WEST"]).count() == 0


def test_revisions(spark):
    rows = published(spark, [("WEST", h, 1.0, 1.0, "preliminary", h) for h in (1, 2, 3)])
    rev = published(spark, [("WEST", 1, 2.0, 2.0, "verified", 1), ("WEST", 1, 3.0, 3.0, "verified", 2), ("WEST", 2, 2.0, None, "verified", 1), ("WEST", 9, 2.0, 2.0, "verified", 1)])
    once = reconcile.apply_revisions(rows, rev)
    got = sorted((r["hour"], r["price_da"], r["price_rt"], r["status"]) for r in once.collect())
    assert got == [(1, 3.0, 3.0, "verified"), (2, 2.0, None, "verified"), (3, 1.0, 1.0, "preliminary")]
    assert sorted(map(tuple, reconcile.apply_revisions(once, rev).collect())) == sorted(map(tuple, once.collect()))
    assert [r["hour"] for r in reconcile.ghost_revisions(rows, rev).collect()] == [9]
    gaps = {r["hub"]: tuple(r)[1:] for r in reconcile.revision_gap(rows, once, 1.5).collect()}
    assert gaps == {"WEST": (0.5, 1.0, 2), None: (0.5, 1.0, 2)}
    assert tuple(reconcile.revision_gap(rows.filter("false"), once).first()) == (None, 0.0, 0.0, 0)
