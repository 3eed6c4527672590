"""The shards that are rewritten hold every row once, and the op1 query describes what its files hold."""

from collections import Counter

from pyspark.sql import functions as F

from pricegate.llm import resharding
from pricegate.llm.queries import queries
from tests.conftest import TESTDATA

ROWS = [(k % 25 if k % 7 else None, None if k % 11 == 0 else f"text {k % 40} " * (k % 5), f"{k}") for k in range(200)]


def test_rows_are_those_of_the_files(spark):
    """Null and repeated doc_ids, and repeated rows, are written once; columns with the same names as ours do no harm."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, size string").repartition(3)
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    got = resharding.resharded(df.withColumns({"__row": F.lit(1), "__old": F.lit(2), "__shard": F.lit("x"), "slot": F.lit(3)}), old, 3, 5)
    assert any("/old-shards-" in f for f in got.inputFiles()) and any("/new-shards-" in f for f in got.inputFiles())
    rows = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len((t or "").encode()) + 8) for d, t, _ in ROWS)
    for k in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    size = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(5)]
    assert max(size) - min(size) < 200
    files = Counter(r["size"] for f in set(got.inputFiles()) if "new-shards" in f for r in spark.read.parquet(f).collect())
    assert files and not files - Counter(s for _, _, s in ROWS)
    assert resharding.resharded(df.filter("false"), old, 3, 5).count() == 0


def test_one_key_for_many_rows(spark):
    """A third of all rows are the same, null doc_id and all; shards are even all the same."""
    df = spark.createDataFrame([(None, "the same") if k % 3 == 0 else (k, f"text {k}" * (k % 9)) for k in range(900)], "doc_id long, text string").repartition(4)
    rows = resharding.resharded(df, F.coalesce(F.col("doc_id") % 2, F.lit(0)), 2, 6).collect()
    size = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(6)]
    assert len(rows) == 900 and max(size) - min(size) < 200


def test_query_writes_documents(spark):
    out = queries()["op1_flow_resharding"](spark, f"{TESTDATA}/sf0.001")
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", (F.octet_length("text") + 8).cast("long"), F.crc32("text"))
    assert all("-shards-" in f or "/files-" in f for f in out.inputFiles()) and any("/__shard=" in f for f in out.inputFiles())
    assert Counter(map(tuple, out.select("doc_id", "size", "text_crc32").collect())) == Counter(map(tuple, docs.collect()))
