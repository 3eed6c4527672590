import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricegate.functions.numbers import printed, shortest
from pricegate.jobs import queries
from pricegate.operators.quantiles import quantiles
from pricegate.operators import bootstrap, evaluate, features, gate, model, monitor, notes

rng = np.random.default_rng(5)
BLOCKS, HUBS = ["peak", "off_peak"], ["A", "B", "C"]


def frame(n=600):
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 100, 1]
    return pd.DataFrame({"key": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": 3.0, "y": 2 * x[:, 0] - x[:, 1] + rng.normal(size=n), "block": rng.choice(BLOCKS, n), "hub": rng.choice(HUBS, n)})


def test_ridge_matches_the_closed_form(spark):
    df = frame()
    x = df[["a", "b", "c"]].to_numpy()
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (df.y - df.y.mean()))
    cols = {c: F.col(c) for c in "abc"}
    got = model.fit(spark.createDataFrame(df).repartition(5), cols, F.col("y"))
    assert np.allclose(got.coef, want, atol=1e-9) and np.isclose(got.intercept, df.y.mean())
    scored = spark.createDataFrame(df).withColumn("p", got.predict(cols)).toPandas()
    assert np.allclose(scored.p, df.y.mean() + z @ want)
    with pytest.raises(ValueError):
        got.predict({"a": F.col("a")})
    bands = {r["block"]: (r["band_lo"], r["band_hi"]) for r in model.residual_bands(spark.createDataFrame(scored)).collect()}
    for b in BLOCKS:
        assert np.allclose(bands[b], np.quantile((scored.y - scored.p)[scored.block == b], [0.05, 0.95]))


def test_segments_coverage_pinball(spark):
    df = frame().assign(p_champion=0.0, p_challenger=lambda x: x.y / 2, lo=-100.0, hi=-98.0)
    s = spark.createDataFrame(df)
    got = {(r["kind"], r["segment"]): r for r in evaluate.segment_errors(s).collect()}
    assert len(got) == 6 and np.isclose(got["overall", "overall"]["diff"], -(df.y.abs() / 2).mean())
    assert got["hub", "A"]["n"] == (df.hub == "A").sum()
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    cover, loss = s.agg(evaluate.coverage(y, lo, hi), evaluate.pinball(y, lo, hi)).first()
    q = lambda t, d: np.maximum(t * d, (t - 1) * d).mean()
    assert np.isclose(cover, df.y.between(-100, -98).mean()) and np.isclose(loss, (q(0.05, df.y + 100) + q(0.95, df.y + 98)) / 2)


def test_psi(spark):
    n = 4000
    df = pd.DataFrame({"ref": [True] * n + [False] * 2000, "same": rng.normal(size=n + 2000), "flat": 1.0})
    df["moved"] = np.where(df.ref, df.same, df.same * 1000)
    got = {r["feature"]: r["psi"] for r in evaluate.psi(spark.createDataFrame(df), ["same", "moved", "flat"], F.col("ref")).collect()}
    assert got["same"] < 4 * 9 * (1 / 4000 + 1 / 2000) and got["moved"] > 1 and got["flat"] == 0


def test_bootstrap_bands(spark):
    df = pd.DataFrame({"key": np.arange(5000), "block": "peak", "hub": rng.choice(HUBS, 5000), "diff": rng.normal(-0.2, 1, 5000)})
    s = spark.createDataFrame(df)
    got = {(r["kind"], r["segment"]): (r["lo"], r["hi"]) for r in bootstrap.bands(s, draws=500).collect()}
    lo, hi = got["overall", "overall"]
    assert lo < df["diff"].mean() < hi < 0 and np.isclose(hi - lo, 2 * 1.96 / np.sqrt(5000), rtol=0.2)
    again = {(r["kind"], r["segment"]): (r["lo"], r["hi"]) for r in bootstrap.bands(s.repartition(9, "hub"), draws=500).collect()}
    assert got.keys() == again.keys() and all(np.allclose(got[k], again[k]) for k in got)
    few = {(r["kind"], r["segment"]): (r["lo"], r["hi"]) for r in bootstrap.bands_by_digest(s, draws=200).collect()}
    assert np.allclose(few["overall", "overall"], (lo, hi), atol=0.02)
    assert bootstrap.bands(s.filter("false"), draws=10).count() == 0


def test_lags_count_calendar_days(spark):
    d0 = dt.date(2026, 1, 1)
    spread = spark.createDataFrame([("A", d0 + dt.timedelta(days=k), float(k)) for k in range(12) if k != 7], "hub string, day date, spread double")
    want = spark.createDataFrame([("A", d0 + dt.timedelta(days=k)) for k in (1, 9, 10, 13)], "hub string, day date")
    got = {(r["day"] - d0).days: (r["lag2_spread"], r["roll7_spread"]) for r in features.spread_lags(spread, want).collect()}
    assert got == {1: (None, None), 9: (None, np.mean([1, 2, 3, 4, 5, 6])), 10: (8.0, np.mean([2, 3, 4, 5, 6, 8])), 13: (11.0, np.mean([5, 6, 8, 9, 10, 11]))}


def test_design_has_the_reference_widths():
    hubs = [f"h{k}" for k in range(11)]
    assert len(features.design(hubs)) == 17 and len(features.design(hubs, interactions=True)) == 19
    with pytest.raises(ValueError):
        features.build(None, None, None, lag_from="tomorrow")


def test_compare_and_suite(spark):
    suite = gate.Suite()
    assert len(suite.checks) == 10
    values = spark.createDataFrame([("r", c, v) for c, v in (("quarantine_rate", 0.001), ("hour_count_days_wrong", None), ("band_coverage", 0.85), ("psi_max", float("nan")), ("overall_improvement", 0.0))], "run_id string, check string, value double")
    got = {r["check"]: (r["passed"], r["reason"]) for r in gate.results(values, suite.frame(spark)).collect()}
    assert got["quarantine_rate"] == (True, "") and got["band_coverage"][0]
    assert not got["hour_count_days_wrong"][0] and not got["psi_max"][0] and not got["overall_improvement"][0]
    assert got["peak_no_regression"] == (False, "no value computed")
    verdict = gate.verdicts(gate.results(values, suite.frame(spark))).first()
    assert (verdict["passed"], verdict["total"], verdict["exit_code"]) == (2, 10, 2)
    with pytest.raises(ValueError):
        gate.load_suite({"checks": {}})
    loaded = gate.load_suite({"split_day": 1, "reference_days": 2, "checks": {"a": {"op": "within", "threshold": [1, 2]}, "b": {"op": "<", "threshold": 3}}})
    assert loaded.checks[0][3:5] == (1.0, 2.0) and loaded.checks[1][3:5] == (3.0, 3.0)
    with pytest.raises(ValueError):
        gate.Suite(checks=(("a", "", ">", 0.0, 0.0, ""),))


def test_quantiles_are_numpys(spark):
    """Few and many values, ties, outliers, a constant, nulls and NaN; more than are looked at one by one."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=30_000), "b": np.round(rng.normal(size=9_000), 1), "c": np.array([3.0] * 6_000), "d": np.array([1.0, 2.0, 4.0]), "e": np.concatenate([rng.uniform(size=9_000), [1e300, -1e300]]), None: np.array([5.0])}
    rows = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()])
    df = spark.createDataFrame([(g if isinstance(g, str) else None, float(x)) for g, x in rows.itertuples(index=False)] + [("a", None), ("d", float("nan"))], "g string, x double")
    at = [0.0, 0.025, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], F.col("x"), at).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, at), rtol=1e-12, atol=1e-12), k


@pytest.mark.parametrize("n", [60, 6000])
def test_quantiles_of_any_doubles(spark, n):
    """Infinities, far outliers, neighbouring denormals, powers of two, one value for half of the rows."""
    inf = float("inf")
    groups = {"inf": [inf] * 3 + [-inf] * 2 + list(range(n)), "all inf": [inf] * n, "far": [1e300, -1e300, *np.linspace(0, 1, n)], "tiny": [5e-324 * (k % 3) for k in range(n)], "powers": [2.0 ** (k % 2000 - 1000) for k in range(n)], "two": [1.0] * (n // 2) + [2.0] * (n - n // 2), "one": [7.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double").repartition(3)
    at = [0.0, 0.3, 0.5, 0.9999, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], F.col("x"), at).collect()}
    for g, xs in groups.items():
        xs = np.sort(np.array(xs, float))
        for q, v in zip(at, got[g], strict=True):
            k = q * (len(xs) - 1)
            lo, hi, part = xs[int(np.floor(k))], xs[int(np.ceil(k))], k - np.floor(k)
            assert np.isclose(v, lo if lo == hi else (1 - part) * lo + part * hi, rtol=1e-12, atol=0), (g, q)


def test_streaks(spark):
    d0 = dt.date(2026, 1, 1)
    flags = [1, 1, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([("s", d0 + dt.timedelta(days=2 * k), bool(f)) for k, f in enumerate(flags)], "series string, day date, outside boolean")
    assert [r["streak"] for r in monitor.streaks(df, ["series"]).orderBy("day").collect()] == [1, 2, 0, 1, 2, 3, 4]
    assert monitor.triggers(df, ["series"]).first()["trigger_day"] == d0 + dt.timedelta(days=10)
    daily = spark.createDataFrame([(d0 + dt.timedelta(days=k), float(k % 3)) for k in range(90)], "day date, mae double")
    band, tail = monitor.control_band(daily).first(), np.array([k % 3 for k in range(29, 90)], float)
    assert np.isclose(band["band_hi"], tail.mean() + 2 * tail.std(ddof=1)) and band["band_lo"] == 0.5


def test_note_filter(spark):
    allowed = notes.allowed_numbers(spark.createDataFrame([("r", 0.8172), ("r", -3.5)], "run_id string, value double"), spark.createDataFrame([("r", "on 2026-01-15 at 99")], "run_id string, text string"))
    drafts = ["Coverage is 0.8172 or 82% or 0.82, -3.50 off, on 2026-01-15, 12 checks.", "It was 37 and 12.5.", "We should ship.\nLower the threshold.", "\n".join("abcdefghi"), None, "at 99% or -99 or 100"]
    df = spark.createDataFrame([("r", k, t) for k, t in enumerate(drafts)], "run_id string, note_id long, note string")
    got = {r["note_id"]: (r["ok"], r["reasons"]) for r in notes.filter_notes(df, allowed).collect()}
    assert got[0] == (True, "") and got[4] == (True, "")
    assert got[1] == (False, "number not in the report: 37")  # a number before a full stop is not seen
    assert got[2] == (False, "moves a threshold: 'lower the threshold'; makes a release decision: 'should ship'")
    assert got[3] == (False, "9 lines; the limit is 8") and got[5] == (False, "number not in the report: 100")
    out = notes.with_fallback(notes.filter_notes(df, allowed), spark.createDataFrame([("r", "T")], "run_id string, note string"))
    assert {r["note_id"]: r["note"] for r in out.collect()}[1] == "T"


def test_diagnosis_order(spark):
    values = spark.createDataFrame([("r", "psi_max", 1.0), ("r", "duplicate_conflicts", 2.0), ("r", "quarantine_rate", 0.0), ("s", "quarantine_rate", 0.0)], "run_id string, check string, value double")
    checks = tuple(c for c in gate.CHECKS if c[0] in ("psi_max", "duplicate_conflicts", "quarantine_rate"))
    res = gate.results(values, gate.Suite(checks=checks).frame(spark))
    got = {r["run_id"]: r for r in notes.diagnose(res).collect()}
    assert (got["r"]["root"], got["r"]["downstream"], got["r"]["passed"]) == ("duplicate_conflicts", "psi_max", "quarantine_rate")
    form = notes.NoteForm(held="{bad}/{total}", cause="{check} {family} {value} {op} {limit}", effects="then {list}", effect="{check} {value}", no_effects="alone", seen="saw {list}", nothing_seen="saw none", action="do {list}", actions={"integrity": "diff {check}"}, any_action="ask", decides="people", passed=("all {total}",))
    facts = spark.createDataFrame([("r", "duplicate_conflicts", k, f"f{k}") for k in range(5)], "run_id string, check string, ord int, fact string")
    got = {r["run_id"]: r["note"] for r in notes.template_notes(res, form, facts).collect()}
    assert got["r"].startswith("2/3\nduplicate_conflicts integrity 2.0000 == 0.0000\nthen psi_max 1.0000\nsaw f0; f1; f2\ndo diff duplicate_conflicts\npeople") and got["s"].split("\n")[0] in ("all 1", "2/3")
    assert notes.evidence(res, {}).count() == 4


def test_shortest_forms_are_pythons(spark):
    some = [0.000731, 12345678.5, 1e-5, 1.5e-7, 0.0001, 1e16, 1.5e16, 9007199254740993.0, 123456789012345.6, 1e15, 100.0, 0.0, -0.000731, -2e20, 0.001, 1e7, 31.2, float("nan"), float("inf"), float("-inf"), 1e22, 1e100]
    rows = spark.createDataFrame([(v,) for v in some], "v double").select(shortest(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [repr(v) for v in some]
    report = notes.allowed_numbers(spark.createDataFrame([("r", 0.000731), ("r", 12345678.5)], "run_id string, value double"))
    drafts = spark.createDataFrame([("r", "it is 0.000731 and 12345678.5 here", 1), ("r", "it is 0.000732 here", 1), ("r", "it is 0.000731 and 12345678.5 here", 2)], "run_id string, note string, note_id int")
    assert sorted((r["note_id"], r["ok"]) for r in notes.filter_notes(drafts, report).collect()) == [(1, False), (1, True), (2, True)]


def test_printed_numbers_follow_the_binary_value(spark):
    some = [0.0, 0.5, 1.5, 2.5, 0.4965, 0.0625, 0.125, 0.375, 2.675, 1.005, -0.4965, -2.5, -1e-9, 0.49999999999999994, 99.99995, 5000.0005, 123456789.0125, 2.0**40 - 0.5]
    some += [k / 2000 for k in range(1, 400, 2)] + [k / 16 + 1000 for k in range(16)]
    rows = spark.createDataFrame([(v,) for v in some], "v double").select("v", *[printed(F.col("v"), d).alias(f"d{d}") for d in range(5)]).collect()
    assert len(rows) == len(some)
    assert all(r[f"d{d}"] == f"{r['v']:.{d}f}" for r in rows for d in range(5))
    assert spark.createDataFrame([(None,)], "v double").select(printed(F.col("v"), 2).alias("t")).first()["t"] is None


def test_a_digest_is_worked_out_once_for_a_draw(spark):
    rows = spark.createDataFrame([(f"{k}-1", "A", "F", float(k)) for k in range(50)], "key string, block string, hub string, diff double")
    plan = bootstrap.bands_by_digest(rows, draws=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 4


def test_weights_by_digest(spark):
    """The steps at and beside each threshold, and those of keys against the law as it is written."""
    edges = [f"{int(x, 16) + k:08x}" + "0" * 24 for x in bootstrap.STEPS for k in (-1, 0, 1)]
    law = lambda digest: sum(int(digest[:8], 16) / 2**32 >= x for x in bootstrap.LADDER)
    got = spark.createDataFrame([(e,) for e in edges], "e string").select("e", bootstrap.weight_of(F.col("e")).alias("w")).collect()
    assert all(r["w"] == law(r["e"]) for r in got) and {r["w"] for r in got} == set(range(8))
    keys = spark.range(200).select("id", bootstrap.poisson_weight(7, F.col("id"), F.lit(3)).alias("w")).collect()
    assert all(r["w"] == law(hashlib.md5(f"7|{r['id']}|3".encode()).hexdigest()) for r in keys)


def test_lines_are_joined_once(spark, small):
    assert "Join" not in queries._scored(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_bands_of_residuals_are_broadcast_and_drift_reads_its_features_only(spark, small):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(queries._banded(spark, small))
    assert "get_json_object" not in plan(queries._psi(spark, small, ["value", "user_id"]))


def test_sums_of_draws_do_not_depend_on_chunks():
    """A row's codes are those of its batch, whatever chunk it is in, and its weights those of plain indexing."""
    b = pd.DataFrame({"run": "", "hashed": np.arange(700) * 977, "block": ["A", None, "R", "A"] * 175, "hub": ["O"] * 300 + ["F"] * 400, "diff": np.arange(700) % 7 - 3.0})
    one, other = (next(bootstrap._draws(7, 50, chunk)(iter([b, b]))).fillna({"segment": "-"}).set_index(["kind", "segment"]).sort_index() for chunk in (64, 700))
    assert len(one) == 6 and one.index.equals(other.index)
    for c in ("wd", "w"):
        assert np.allclose(np.stack(one[c]), np.stack(other[c]))
    assert np.allclose(np.stack(one["w"]).mean(1), [len(b) * 2 * x for x in (0.25, 0.5, 0.25, 4 / 7, 3 / 7, 1)], rtol=0.1)
