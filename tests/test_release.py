"""The release decision of many runs at once against the same steps one run at a time in pandas and NumPy."""

import json

import numpy as np
import pandas as pd
import pytest

from pricegate.jobs import queries
from pricegate.operators import gate
from pricegate.sources import adapters as a


@pytest.fixture(scope="module")
def made(spark, small):
    release = queries._release(spark, small)
    results = release.results(queries.RELEASE).toPandas()
    return release, results.set_index(["run_id", "check"])["value"]


@pytest.fixture(scope="module")
def feed(spark, small):
    f = a.release_feeds(spark, small)
    return f.rows.toPandas(), f.revisions.toPandas(), f.forecasts.toPandas()


def by_hand(rows, revisions, loads, skew=False):
    """Coverage, PSI, mean differences by segment and the difference itself of a run whose rows all pass."""
    key = ["hub", "day", "hour"]
    final = rows.merge(revisions[[*key, "price_da", "price_rt"]], on=key, suffixes=("_old", ""))
    daily = rows.assign(s=rows.price_rt - rows.price_da).groupby(["hub", "day"]).s.mean().unstack(0)
    daily.index = pd.to_datetime(daily.index)
    lag = {"lag2_spread": daily.shift(2), "roll7_spread": pd.concat([daily.shift(k) for k in range(2, 9)]).groupby(level=0).mean()}
    df = final.merge(loads, on=key)
    df["day"] = pd.to_datetime(df.day)
    for n, t in lag.items():
        df = df.merge(t.stack().rename(n).reset_index(), on=["day", "hub"], how="left")
    df = df.dropna(subset=list(lag))
    df["y"], df["n"] = df.price_rt - df.price_da, (df.day - pd.Timestamp(a.FIRST_DAY)).dt.days
    df["block"] = np.select([df.hour.between(12, 19), df.hour.between(8, 11) | df.hour.between(20, 22)], ["peak", "shoulder"], "off_peak")
    x = df[["price_da", "load_forecast_mw", "lag2_spread", "roll7_spread"]].assign(w=(df.day.dt.weekday < 5) * 1.0, p=(df.block == "peak") * 1.0, s=(df.block == "shoulder") * 1.0, **{h: (df.hub == h) * 1.0 for h in a.TYPES[1:]})
    both = x.assign(sq=x.price_da**2, pk=x.p * x.price_da)
    train, test = df.n < 20, df.n.between(20, 25)
    out = {}
    for name, design in (("champion", x), ("challenger", both)):
        t = design[train]
        mean, scale = t.mean(), t.std(ddof=0).where(lambda v: v > 1e-12, 1.0)
        z = ((t - mean) / scale).to_numpy()
        beta = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (df.y[train] - df.y[train].mean()))
        predict = lambda d, mean=mean, scale=scale, beta=beta: df.y[train].mean() + ((d - mean) / scale).to_numpy() @ beta
        served = design.assign(sq=0.0) if skew and name == "challenger" else design
        out[name] = predict(served[test])
        if name == "challenger":
            left = pd.Series(df.y[train] - predict(t), index=t.index)
            bands = left.groupby(df.block[train]).quantile([0.05, 0.95]).unstack()
    y, block = df.y[test].to_numpy(), df.block[test]
    lo, hi = (out["challenger"] + bands[q].reindex(block).to_numpy() for q in (0.05, 0.95))
    diff = pd.Series(np.abs(y - out["challenger"]) - np.abs(y - out["champion"]), index=df.index[test])
    psi = []
    for c in ("price_da", "load_forecast_mw"):
        ref, cur = df[c][df.n.between(10, 19)], df[c][test]
        edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
        edges[0], edges[-1] = -np.inf, np.inf
        r, s = (np.maximum(np.histogram(v, edges)[0] / len(v), 1e-4) for v in (ref, cur))
        psi.append(((s - r) * np.log(s / r)).sum())
    return ((y >= lo) & (y <= hi)).mean(), max(psi), diff, block, df.hub[test]


@pytest.mark.parametrize("run", ["clean", "load_units", "skew"])
def test_model_checks(made, feed, run):
    rows, revisions, loads = feed
    if run == "load_units":
        late = pd.to_datetime(loads.day) >= pd.Timestamp(a.FIRST_DAY) + pd.Timedelta(days=20)
        loads = loads.assign(load_forecast_mw=loads.load_forecast_mw.where(~late, loads.load_forecast_mw * 1000))
    coverage, psi, diff, block, hub = by_hand(rows, revisions, loads, run == "skew")
    got = made[1][run]
    assert np.isclose(got["band_coverage"], coverage) and np.isclose(got["psi_max"], psi)
    rng = np.random.default_rng(1)
    draw = lambda d: np.quantile(d.to_numpy()[rng.integers(0, len(d), (2000, len(d)))].mean(1), [0.025, 0.975])
    width = lambda d: 4 * d.std() / np.sqrt(len(d)) / np.sqrt(20) + 1e-9
    assert abs(got["overall_improvement"] - draw(diff)[1]) < width(diff)
    assert abs(got["peak_no_regression"] - draw(diff[block == "peak"])[0]) < width(diff[block == "peak"])
    assert abs(got["hub_no_regression"] - max(draw(diff[hub == h])[0] for h in a.TYPES)) < max(width(diff[hub == h]) for h in a.TYPES)


def test_clean_run_ships_and_every_check_fails_somewhere(spark, made):
    release, _ = made
    results = release.results(queries.RELEASE)
    verdict = {r["run_id"]: r for r in gate.verdicts(results).collect()}
    assert verdict["clean"]["exit_code"] == 0 and verdict["retry"]["exit_code"] == 0 and verdict["clean"]["total"] == 10
    assert {r["check"] for r in results.filter("not passed").collect()} == {c[0] for c in gate.CHECKS}


def test_evidence_of_every_check(spark, small):
    rows = queries.release_evidence(spark, small).collect()
    assert {r["check"] for r in rows} == {c[0] for c in gate.CHECKS} and all(r["evidence"] for r in rows)
    at = {(r["run_id"], r["check"]): json.loads(r["evidence"]) for r in rows}
    assert at["hour_shift", "hour_count_days_wrong"] == [{"hub": "error", "day": "2024-01-10", "hours_seen": 23, "hours_expected": 24}]
    assert at["conflict", "duplicate_conflicts"] == {"conflicting_keys": 1}
    assert at["copies_off", "quarantine_rate"] == {"unit_not_usd_mwh": 120}
    assert at["copies_off", "reconcile_share_off"]["tolerance"] == 2.0
    assert at["skew", "hub_no_regression"]["lo"] == pytest.approx(max(r["lo"] for r in queries._release(spark, small).bands.filter("run_id = 'skew' and kind = 'hub'").collect()))
    assert set(at["load_units", "psi_max"]) == {"price_da", "load_forecast_mw", "lag2_spread", "roll7_spread"}


def test_suite_file(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"split_day": 3, "reference_days": 2, "seed": 5, "reconcile_tolerance": 1.5, "checks": {"a": {"op": "<", "threshold": 3}}}))
    suite = gate.read_suite(str(tmp_path / "s.json"))
    assert (suite.split_day, suite.reference_days, suite.seed, suite.tolerance, suite.monitor_from_day) == (3, 2, 5, 1.5, 10**6)
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("split_day: 3\nreference_days: 2\nchecks:\n  a: {op: within, threshold: [1, 2]}\n")
    assert gate.read_suite(str(tmp_path / "s.yaml")).checks[0][3:5] == (1.0, 2.0)
