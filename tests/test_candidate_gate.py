"""The release decision's bands against a bootstrap of resampled rows in NumPy."""

import numpy as np

import __spark_entry__ as entry
from pricegate.jobs import queries as core
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def test_candidate_gate_takes_the_suites_draws(spark):
    got = {r["check"]: r["value"] for r in entry.queries()["candidate_gate_bands"](spark, SF).collect()}
    rows = core._differences(spark, SF).toPandas()
    rng = np.random.default_rng(1)

    def band(diff, draws=2000):
        means = np.array([rng.choice(diff, len(diff)).mean() for _ in range(draws)])
        return np.quantile(means, [0.025, 0.975]), means.std()

    diff = rows["diff"].to_numpy(float)
    (_, hi), off = band(diff)
    assert abs(got["overall_improvement"] - hi) < 0.25 * off
    (lo, _), off = band(rows.loc[rows["block"] == "R", "diff"].to_numpy(float))
    assert abs(got["peak_no_regression"] - lo) < 0.25 * off
