import os
import re

from pyspark.sql import functions as F

import corpus_pipeline
from pricegate.llm.common import stored
from pricegate.llm.quality import classify
from pricegate.llm.queries import oracle_sql, queries
from pricegate.sources.folders import shared_root
from tests.conftest import TESTDATA
from tests.llm.test_operators import check_packing, groups_of, least


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries()] == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "secret scan", "packing"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.lit(1))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r["doc_id"] for r in classify(docs, labels).filter("predicted = 1").collect()}
    (_, keep), (_, copies), (_, near), (_, redact), (_, pack) = corpus_pipeline.STAGES
    one = stored(keep(spark, docs, small), "one")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == good
    two = stored(copies(spark, one, small), "two")
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    ids = sorted(rows)
    kept = groups_of([rows[i] for i in ids])
    assert {r["doc_id"] for r in two.collect()} == {ids[k] for k in kept.values()}
    three = stored(near(spark, two, small), "three")
    assert three.columns == docs.columns and 0 < three.count() <= two.count()
    four = stored(redact(spark, three, small), "four")
    assert four.columns == docs.columns and four.count() == three.count()
    assert four.filter(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() == 0
    final = {r["doc_id"]: r["text"] for r in four.collect()}
    out = pack(spark, four, small).collect()
    order = sorted(final)
    renumbered = [{**r.asDict(), "doc_id": order.index(r["doc_id"])} for r in out]
    assert check_packing(renumbered, [final[i] for i in order]) > 0.8


def test_run(spark):
    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, f"{TESTDATA}/sf0.001")
    assert out.count() > 0
    left = set(os.listdir(root)) - before  # of all that was stored, the result is left
    assert {os.path.basename(out.stored_at)} == {x for x in left if not x.startswith(".")}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, kept int, stay int, gone int, random int, fp int, twice int, digest int"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, ids beyond 2^53, and columns named like ours."""
    clean = "This is a clean text, and it has some sentences. They end with a stop, as they should; number "
    more = ("b", 1, 2, 3, 4, 5, 6, 7)
    rows = [(k, clean * 3 + str(k), "en", "s", 1, *more) for k in range(40)]
    rows += [(k, clean * 3 + str(k), "en", "s", 1, *more) for k in range(5)]  # repeated
    rows += [(100 + k, clean * 3 + " 7", None, None, None, *[None] * 8) for k in range(6)]  # ties
    rows += [(200, None, "en", "s", None, *more), (201, "", "en", "s", 0, *more), (None, None, None, None, None, *[None] * 8), (None, clean * 2 + "null id", "en", "s", 1, *more)]
    rows += [(2**53 + 1, clean * 4_000, "en", "s", 1, *more), (2**53 + 3, clean * 2 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "s", 1, *more)]
    return rows


def test_odd_rows_pass_all_stages(spark, small):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    (_, keep), (_, copies), (_, near), (_, redact), (_, pack) = corpus_pipeline.STAGES
    one = keep(spark, docs, small)
    assert one.columns == docs.columns and one.count() <= len(rows)
    two = stored(copies(spark, docs, small), "two")
    left = sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=str)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in rows:
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[plain(r[1])] = min(best.get(plain(r[1]), rank), rank)
    assert [(d, plain(t)) for d, t in left] == sorted(((None if no else d, p) for p, (_, no, d) in best.items()), key=str) and two.columns == docs.columns
    three = stored(near(spark, two, small), "three")
    sets = {d: set(zip(*[(t or "").lower().split()[k:] for k in range(5)], strict=False)) or {(t or "").lower()} for d, t in left if d is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {d for d, r in least(edges, sets).items() if d == r}
    got = [r["doc_id"] for r in three.collect()]
    assert {d for d in got if d is not None} == want and got.count(None) == sum(d is None for d, _ in left) and three.columns == docs.columns
    four = stored(redact(spark, docs, small), "four")
    assert four.columns == docs.columns and four.count() == len(rows)
    changed = {r["doc_id"]: r["text"] for r in four.collect()}
    assert "[SECRET]" in changed[2**53 + 3] and "24be64" not in changed[2**53 + 3] and changed[200] is None and changed[2**53 + 1] == dict((r[0], r[1]) for r in rows)[2**53 + 1]
    out = pack(spark, docs, small).collect()
    assert sum(r["start"] == 0 for r in out) == len(rows) and {r["doc_id"] for r in out} == {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), small).count() == 0, name


def test_run_of_an_empty_table(spark, tmp_path, small):
    spark.read.parquet(f"{small}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
