"""Bands of many draws with the weights of digests."""

import hashlib
import math

import numpy as np
import pandas as pd

import __spark_entry__ as entry
from pricegate.functions.digests import first_words
from pricegate.jobs import queries as core
from pricegate.operators import bootstrap


def bands(df):
    return {(r["kind"], r["segment"]): (r["lo"], r["hi"]) for r in df.collect()}


def test_paired_bootstrap_takes_all_draws(spark, small):
    """Edges lie where 2,000 draws of resampled rows have them; those of 16 draws lie up to 1.1 standard deviations off."""
    assert "unnest(range(0, 2000)) AS draw" in entry.oracle_sql()["paired_bootstrap"]
    got, rows = bands(entry.queries()["paired_bootstrap"](spark, small)), core._differences(spark, small).toPandas()
    rng = np.random.default_rng(1)
    for (kind, segment), edges in got.items():
        diff = (rows if kind == "overall" else rows[rows[kind] == segment])["diff"].to_numpy(float)
        means = np.array([rng.choice(diff, len(diff)).mean() for _ in range(2000)])
        assert np.all(np.abs(np.array(edges) - np.quantile(means, [0.025, 0.975])) < 0.25 * means.std())
    assert len(got) == 6


def test_first_words_are_those_of_hashlib():
    """Texts of up to four blocks, also where the number of blocks depends on the suffix."""
    rng = np.random.default_rng(2)
    prefixes = [rng.bytes(n) for n in [*range(140), *range(50, 60), 200]]
    for suffixes in ([str(k).encode() for k in range(1003)], [b"", b"x" * 70, b"yy"], [b"7"]):
        want = [[int(hashlib.md5(p + s).hexdigest()[:8], 16) for s in suffixes] for p in prefixes]
        assert np.array_equal(first_words(prefixes, suffixes), np.array(want, np.uint32))


def test_digests_in_tasks_give_the_bands_of_built_in_functions(spark):
    n = 900
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"key": [f"{k}-é" * (1 + k % 5) for k in range(n)], "block": rng.choice(["A", "N", "?"], n), "hub": rng.choice(["F", "O"], n), "diff": rng.normal(2, 1, n)})
    known = "case when block = '?' or hash(key) % 7 = 0 then null else diff end as diff"
    rows = spark.createDataFrame(df).selectExpr("case when hash(key) % 11 = 0 then null else key end as key", "block", "nullif(hub, 'O') as hub", known)
    want, got = bands(bootstrap.bands_by_digest(rows, draws=41)), bands(bootstrap.bands_by_digests(rows, draws=41))
    assert got.keys() == want.keys() and len(got) == 6 and got["block", "?"] == want["block", "?"] == (None, None)
    assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in got if k != ("block", "?"))
    assert bootstrap.bands_by_digests(rows.filter("false"), draws=5).count() == 0


def test_a_draw_without_weight_has_no_mean(spark):
    """As in the SQL: such draws are NaN and lie above all others."""
    rows = spark.createDataFrame([("1", "A", "F", 2.0), ("2", "N", "F", 3.0)], "key string, block string, hub string, diff double")
    got = bands(bootstrap.bands_by_digests(rows, draws=400))
    assert got["block", "A"][0] == 2.0 and math.isnan(got["block", "A"][1]) and got["hub", "F"][0] == 2.0
