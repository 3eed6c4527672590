"""Every query with SQL against DuckDB, and the others for rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
QUERIES, SQL = entry.core.queries(), entry.oracles.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    cols = [c[0] for c in out.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in out.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_defect_matrix_holds(spark):
    assert all(r["ok"] for r in QUERIES["defect_matrix"](spark, SF).collect())
