"""The release gate: named numbers against a suite of thresholds, for one run or many at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten checks in their order, each with family, operator, lower and upper threshold.
CHECKS = [
    ("quarantine_rate", "data_quality", "<=", 0.005, 0.005, "rows fail the contract"),
    ("hour_count_days_wrong", "data_quality", "==", 0.0, 0.0, "a hub-day has other hours than the calendar"),
    ("duplicate_conflicts", "integrity", "==", 0.0, 0.0, "two copies of a row disagree"),
    ("reconcile_share_off", "reconciliation", "<=", 0.02, 0.02, "too many hours differ between the two hourly copies"),
    ("reconcile_mean_abs", "reconciliation", "<=", 0.5, 0.5, "the two hourly copies lie apart on average"),
    ("overall_improvement", "accuracy", "<", 0.0, 0.0, "the challenger is not better by more than noise"),
    ("peak_no_regression", "regression", "<=", 0.0, 0.0, "the challenger is worse at the peak"),
    ("hub_no_regression", "bias", "<=", 0.0, 0.0, "the challenger is worse at a hub"),
    ("band_coverage", "calibration", "within", 0.85, 0.95, "the band does not hold the share it promises"),
    ("psi_max", "drift", "<=", 0.25, 0.25, "an input has moved"),
]
OPERATORS = ("<=", "<", "==", "within")


@dataclass(frozen=True)
class Suite:
    """Thresholds and windows as data."""

    checks: tuple[tuple, ...] = tuple(CHECKS)
    split_day: int = 92
    monitor_from_day: int = 115
    reference_days: int = 60
    tolerance: float = 2.0
    seed: int = 7
    drift_features: tuple[str, ...] = ("price_da", "load_forecast_mw")
    draws: int = field(default=2000)

    def __post_init__(self):
        unknown = {c[2] for c in self.checks} - set(OPERATORS)
        if unknown:
            raise ValueError(f"unknown operators {sorted(unknown)}")

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per check: ord, check, family, op, lo, hi, why."""
        return spark.createDataFrame([(k, *c) for k, c in enumerate(self.checks)], "ord int, check string, family string, op string, lo double, hi double, why string")


def read_suite(path: str) -> Suite:
    """A suite from a JSON file, or a YAML file where a library for it is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return load_suite(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a suite in YAML needs the yaml library; JSON does without") from e
    return load_suite(yaml.safe_load(text))


def load_suite(spec: dict) -> Suite:
    """A suite from parsed YAML or JSON; split_day, reference_days and checks must be there. Without monitor_from_day all days from the split on are tested."""
    missing = {"split_day", "reference_days", "checks"} - set(spec)
    if missing:
        raise ValueError(f"suite lacks {sorted(missing)}")
    checks = []
    for name, c in spec["checks"].items():
        t = c["threshold"]
        lo, hi = (t, t) if isinstance(t, (int, float)) else t
        checks.append((name, c.get("family", ""), c["op"], float(lo), float(hi), c.get("why", "")))
    known = {k: spec[k] for k in ("split_day", "monitor_from_day", "reference_days", "seed") if k in spec}
    if "drift_features" in spec:
        known["drift_features"] = tuple(spec["drift_features"])
    known = {"monitor_from_day": 10**6} | known
    return Suite(tuple(checks), tolerance=float(spec.get("reconcile_tolerance", 2.0)), **known)


def values(summary: DataFrame, names: list[str], run: str = "run_id") -> DataFrame:
    """(run_id, check, value) from a row per run with a column per check."""
    return summary.select(run, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([run], names, "check", "value")


def compare(value: Column, op: Column, lo: Column, hi: Column) -> Column:
    """Whether a value passes; null and NaN never do."""
    holds = F.when(op == "<=", value <= hi).when(op == "<", value < hi).when(op == "==", value == lo).when(op == "within", value.between(lo, hi))
    return F.when(value.isNull() | F.isnan(value), False).otherwise(F.coalesce(holds, F.lit(False)))


def results(checked: DataFrame, suite: DataFrame, run: str = "run_id") -> DataFrame:
    """Every check of the suite for every run, in suite order: value, passed and, on failure, the reason.

    A check without a value fails. The suite is a small table and is broadcast.
    """
    runs = checked.select(run).distinct()
    every = runs.join(F.broadcast(suite))
    out = every.join(checked.withColumn("__there", F.lit(True)), [run, "check"], "left")
    passed = compare(F.col("value"), F.col("op"), F.col("lo"), F.col("hi"))
    reason = F.when(F.col("__there").isNull(), "no value computed").when(passed, "").otherwise(F.col("why"))
    return out.select(run, "ord", "check", "family", "value", "op", "lo", "hi", passed.alias("passed"), reason.alias("reason"))


def verdicts(result: DataFrame, run: str = "run_id") -> DataFrame:
    """passed, total and exit_code (0 ships, 2 holds) of each run."""
    ok = F.count(F.when(F.col("passed"), 1))
    return result.groupBy(run).agg(ok.alias("passed"), F.count("*").alias("total"), F.when(F.bool_and("passed"), 0).otherwise(2).alias("exit_code"))


def report(result: DataFrame, verdict: DataFrame, run: str = "run_id") -> DataFrame:
    """One nested row per run, for a JSON sink."""
    check = F.struct("ord", "check", "family", "value", "op", "lo", "hi", "passed", "reason")
    return result.groupBy(run).agg(F.array_sort(F.collect_list(check)).alias("checks")).join(verdict, run)
