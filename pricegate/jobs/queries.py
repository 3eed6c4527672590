"""The registered queries of the library: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.numbers import fixed
from ..operators import bootstrap, contract, defects, evaluate, features, gate, model, monitor, notes, reconcile, release
from ..sources import adapters as a
from ..sources import feeds, files
from ..sources.folders import new_folder, stored

#: Hub and day of seeded defects.
HUB, DAY = "error", "2024-01-10"
#: Data checks of a daily run on the derived feed, with thresholds of its own, as a suite's file states them.
DAILY = gate.load_suite({
    "split_day": 20, "monitor_from_day": 26, "reference_days": 10, "reconcile_tolerance": 20.0,
    "checks": {
        "quarantine_rate": {"family": "data_quality", "op": "<=", "threshold": 0.2, "why": "rows fail the contract"},
        "hour_count_days_wrong": {"family": "data_quality", "op": "<=", "threshold": 3, "why": "a hub-day has other hours than the calendar"},
        "duplicate_conflicts": {"family": "integrity", "op": "==", "threshold": 0, "why": "two copies of a row disagree"},
        "reconcile_share_off": {"family": "reconciliation", "op": "<", "threshold": 0.06, "why": "too many hours differ between the two hourly copies"},
        "reconcile_mean_abs": {"family": "reconciliation", "op": "within", "threshold": [2.0, 7.0], "why": "the two hourly copies lie apart on average"},
        "band_coverage": {"family": "calibration", "op": "within", "threshold": [0.85, 0.95], "why": "the band does not hold the share it promises"},
    },
})
SPLIT, MONITOR_FROM, REFERENCE, TOLERANCE = DAILY.split_day, DAILY.monitor_from_day, DAILY.reference_days, DAILY.tolerance
DEFECT_SUITE = gate.Suite(checks=(("quarantine_rate", "data_quality", "<=", 0.05, 0.05, ""), ("hour_count_days_wrong", "data_quality", "==", 0.0, 0.0, ""), ("duplicate_conflicts", "integrity", "==", 0.0, 0.0, "")))

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles in fixed-point form."""
    return df.withColumns({c: fixed(F.col(c), digits) for c, t in df.dtypes if t == "double"})


# calendar


@query
def calendar_hours(spark, d):
    days = a.calendar_days(spark, d)
    day = F.col("day")
    return days.select("day", cal.local_midnight_utc(day).alias("midnight_utc"), cal.hours_in_local_day(day).alias("hours"), cal.intervals_in_local_day(day).alias("intervals"))


@query
def utc_round_trip(spark, d):
    rows = a.calendar_hours(spark, d).withColumn("utc", cal.hour_ending_utc(F.col("day"), F.col("position")))
    back_day, back = cal.utc_to_local_day_hour(F.col("utc"))
    return rows.select("day", "position", "utc", back_day.alias("back_day"), back.alias("back"))


@query
def hour_labels(spark, d):
    rows = a.calendar_hours(spark, d)
    return rows.select("day", "position", cal.hour_ending_label(F.col("day"), F.col("position")).alias("label"), cal.clock_hour(F.col("day"), F.col("position")).alias("clock"))


@query
def hour_blocks(spark, d):
    rows = a.calendar_hours(spark, d).withColumn("clock", cal.clock_hour(F.col("day"), F.col("position")))
    return rows.groupBy(cal.hour_block(F.col("clock")).alias("block")).agg(F.count("*").alias("n"), F.countDistinct("clock").alias("clocks"))


@query
def positions_hourly(spark, d):
    rows = a.clock_stamps(spark, d, [0])
    stamped = rows.withColumns({"file_day": F.col("day"), "stamp": F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("clock") - 1)}).drop("clock", "minute")
    return feeds.hourly_positions(stamped, F.col("stamp")).select("day", "stamp", "position", "hour")


@query
def positions_interval(spark, d):
    rows = a.clock_stamps(spark, d, list(range(5, 65, 5)))
    return cal.with_positions(rows, ["zone"], "day", "clock", "minute", ["seq"]).select("day", "clock", "minute", "position", "hour")


# feeds


@query
def interval_integration(spark, d):
    rows = feeds.only_hubs(a.interval_feed(spark, d), [t for t in a.TYPES if t != "signup"])
    return rounded(feeds.integrate_intervals(rows, F.col("stamp")))


@query
def forecast_vintage(spark, d):
    return rounded(feeds.forecast_vintage(a.forecast_wide(spark, d), a.TYPES))


@query
def published_rows(spark, d):
    return a.preliminary(spark, d)


@query
def verified_rows(spark, d):
    return feeds.verified_rows(a.day_ahead(spark, d), a.hourly(spark, d))


@query
def feed_extent(spark, d):
    return feeds.feed_extent(a.preliminary(spark, d))


@query
def table_manifest(spark, d):
    return files.table_manifest({t: a.table(spark, d, t) for t in ("events", "orders", "lineitem")})


@query
def manifest_changes(spark, d):
    """Days of the feed against the same feed without a day and with another value."""
    daily = lambda rows: rows.groupBy("day").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.round(F.col("price_da") * 100).cast("long"), F.lit(0))).alias("cents"))
    rows = a.preliminary(spark, d)
    first, last = F.lit(a.FIRST_DAY).cast("date"), F.date_add(F.lit(a.FIRST_DAY).cast("date"), 9)
    other = rows.filter(F.col("day") != first).withColumn("price_da", F.when(F.col("day") == last, F.col("price_da") + 1).otherwise(F.col("price_da")))
    return files.manifest_differences(daily(rows), daily(other), "day")


@query
def daily_files(spark, d):
    """A zip archive for each day of events, with a CSV file whose header differs by day, read back by line."""
    lines = files.in_order(files.daily_lines(a.daily_archives(spark, d), dt.date(2024, 1, 3), dt.date(2024, 1, 26)))
    plain = files.plain_columns(lines)
    return plain.select("file_day", "time_stamp", "zone", F.col("ptid").cast("long").alias("ptid"), F.col("lbmp").cast("double").alias("lbmp"), "losses", (F.col("seq") % (1 << 32)).alias("line"), F.shiftright("seq", 32).alias("place"))


@query
def price_table(spark, d):
    """The interval feed written as a CSV table of several files and read back in its order of publication."""
    path = new_folder(spark, "prices")
    feed = a.interval_feed(spark, d)
    table = feed.select("file_day", F.date_format("stamp", feeds.INTERVAL).alias("time_stamp"), "zone", F.col("seq").cast("int").alias("ptid"), F.col("lbmp").cast("decimal(18,4)").alias("lbmp"), F.lit(0.0).alias("losses"), F.lit(None).cast("double").alias("congestion"))
    table.repartitionByRange(4, "ptid").sortWithinPartitions("ptid").write.option("header", True).csv(path)
    rows = feeds.read_prices(spark, path).groupBy("file_day", "zone")
    return rounded(rows.agg(F.count("*").alias("rows"), F.count("congestion").alias("congested"), F.sum("lbmp").alias("total"), F.min_by("ptid", "seq").alias("first"), F.max_by("ptid", "seq").alias("last")), 3)


@query
def landed_days(spark, d):
    """The interval feed as it is landed: a folder of Parquet files for each day, counted as read back."""
    path = new_folder(spark, "days")
    files.write_days(a.interval_feed(spark, d).withColumnRenamed("file_day", "day"), path)
    rows = spark.read.parquet(path)
    return rounded(rows.groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("seq").alias("keys"), F.sum("lbmp").alias("total"), F.max("stamp").alias("last")), 3)


@query
def verified_days(spark, d):
    """Landed days, read back only as their manifest says: size and hash of every file."""
    path = new_folder(spark, "days")
    files.write_days(a.interval_feed(spark, d).withColumnRenamed("file_day", "day"), path)
    manifest = stored(files.file_manifest(spark, f"{path}/*/*.parquet"), "manifest")
    rows = files.read_verified(spark, path, manifest, "*/*.parquet")
    return rounded(rows.groupBy("day").agg(F.count("*").alias("rows"), F.countDistinct("seq").alias("keys"), F.sum("lbmp").alias("total")), 3)


@query
def merged_days(spark, d):
    """Published rows landed by day, and revisions of every third day merged into them."""
    path = new_folder(spark, "merged")
    f = a.stored_feeds(spark, d)
    files.write_days(f.preliminary, path)
    files.merge_days(path, a.revisions(spark, d).filter("dayofmonth(day) % 3 = 0"), "merge")
    return spark.read.parquet(path)


# contract


@query
def contract_reasons(spark, d):
    return contract.with_reason(a.contract_rows(spark, d), a.EVENTS).select("event_id", "reason")


@query
def contract_accepted(spark, d):
    accepted, _ = contract.validate(a.contract_rows(spark, d), a.EVENTS)
    return accepted


@query
def contract_payload(spark, d):
    return contract.with_reason(a.contract_payloads(spark, d), a.EVENTS, "payload").select("event_id", "reason")


@query
def payload_accepted(spark, d):
    rows = contract.with_reason(a.contract_payloads(spark, d), a.EVENTS, "payload")
    return rows.filter("reason is null").select("event_id", *contract.typed_payload())


@query
def reason_counts(spark, d):
    _, quarantined = contract.validate(a.contract_rows(spark, d), a.EVENTS)
    return contract.reason_counts(quarantined)


@query
def quarantine_rate(spark, d):
    return rounded(contract.quarantine_rate(contract.with_reason(a.contract_rows(spark, d), a.EVENTS)))


# reconciliation


def _split(spark, d):
    return reconcile.split_duplicates(a.duplicates(spark, d), a.DUPLICATE_KEY, a.DUPLICATE_VALUES, a.DUPLICATE_ORDER)


@query
def dedup_clean(spark, d):
    return _split(spark, d)[0]


@query
def dedup_conflicts(spark, d):
    return _split(spark, d)[1].drop("place")


@query
def dedup_counts(spark, d):
    return _split(spark, d)[2]


@query
def interval_counts(spark, d):
    return reconcile.interval_counts(a.preliminary(spark, d), [*a.TYPES, "refund"])


@query
def wrong_days(spark, d):
    return reconcile.wrong_days(reconcile.interval_counts(a.preliminary(spark, d), a.TYPES)).groupBy("hub").agg(F.count("*").alias("days"), F.sum("hours_seen").alias("hours_seen"))


def _final(spark, d):
    return reconcile.apply_revisions(a.preliminary(spark, d), a.revisions(spark, d))


@query
def revised_rows(spark, d):
    return _final(spark, d)


@query
def ghost_revisions(spark, d):
    return reconcile.ghost_revisions(a.preliminary(spark, d), a.revisions(spark, d)).select("hub", "day", "hour")


@query
def revision_gap(spark, d):
    return rounded(reconcile.revision_gap(a.preliminary(spark, d), _final(spark, d), TOLERANCE))


@query
def hourly_copies(spark, d):
    """The integrated price against the publisher's hourly one."""
    rows = feeds.published_rows(a.day_ahead(spark, d), a.hourly(spark, d))
    return rounded(reconcile.revision_gap(a.preliminary(spark, d), rows, TOLERANCE))


# features


@query
def daily_spread(spark, d):
    return rounded(features.daily_spread(a.preliminary(spark, d)))


@query
def spread_lags(spark, d):
    rows = a.preliminary(spark, d)
    return rounded(features.spread_lags(features.daily_spread(rows), rows))


def _features(spark, d, **more):
    return features.build(_final(spark, d), a.preliminary(spark, d), a.forecasts(spark, d), **more)


@query
def feature_rows(spark, d):
    return rounded(_features(spark, d)).select("hub", "day", "hour", "price_da", "price_rt", "y", "load_forecast_mw", "clock_hour", "block", "weekday", "lag2_spread", "roll7_spread")


@query
def feature_rows_leaked(spark, d):
    return rounded(_features(spark, d, lag_from="verified")).select("hub", "day", "hour", "lag2_spread", "roll7_spread")


@query
def design_rows(spark, d):
    cols = features.design(a.TYPES, interactions=True)
    return rounded(_features(spark, d).select("hub", "day", "hour", *[c.alias(n) for n, c in cols.items()]))


@query
def window_split(spark, d):
    w = features.windows(F.lit(a.FIRST_DAY).cast("date"), SPLIT, MONITOR_FROM, REFERENCE)
    return _features(spark, d).groupBy(w["name"].alias("name"), w["reference"].alias("reference")).agg(F.count("*").alias("n"))


# models

CHAMPION = ["x1"]
CHALLENGER = ["x1", "x2"]


def _columns(names: list[str]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _fits(rows: DataFrame) -> tuple[model.Ridge, model.Ridge]:
    """Champion and challenger from one aggregate."""
    sums = model.sums(rows, _columns(CHALLENGER), F.col("y"))
    return sums.ridge(tuple(CHAMPION)), sums.ridge(tuple(CHALLENGER))


def _lines(spark, d) -> DataFrame:
    """The lines with their predictors, joined once: fits, scores and bands read them several times."""
    return stored(a.predictions(spark, d), "lines")


def _scored(spark, d) -> DataFrame:
    rows = _lines(spark, d)
    champion, challenger = _fits(rows)
    return rows.withColumns({"p_champion": champion.predict(_columns(CHAMPION)), "p_challenger": challenger.predict(_columns(CHALLENGER))})


@query
def ridge_fit(spark, d):
    champion, challenger = _fits(_lines(spark, d))
    return rounded(champion.frame(spark, "champion").unionByName(challenger.frame(spark, "challenger")), 3)


@query
def ridge_score(spark, d):
    return rounded(_scored(spark, d).select("key", "y", "p_champion", "p_challenger"), 3)


@query
def serving_skew(spark, d):
    """The challenger's error if serving loses its second predictor."""
    rows = _lines(spark, d)
    _, m = _fits(rows)
    lost = m.predict({"x1": F.col("x1"), "x2": F.lit(0.0) * F.col("x2")})
    return rounded(rows.groupBy("block").agg(F.avg(F.abs(F.col("y") - m.predict(_columns(CHALLENGER)))).alias("mae"), F.avg(F.abs(F.col("y") - lost)).alias("mae_skewed")), 3)


@query
def spread_model(spark, d):
    """Champion and challenger on the feature rows of the training window."""
    rows = stored(_features(spark, d).filter(F.datediff("day", F.lit(a.FIRST_DAY).cast("date")) < SPLIT), "train")
    sums = model.sums(rows, features.design(a.TYPES, True), F.col("y"))
    parts = [sums.ridge(tuple(features.design(a.TYPES, both))).frame(spark, name) for name, both in (("champion", False), ("challenger", True))]
    return rounded(a.union(parts), 4)


@query
def residual_bands(spark, d):
    return rounded(model.residual_bands(_scored(spark, d), p="p_challenger"), 3)


def _banded(spark, d, scored: DataFrame | None = None) -> DataFrame:
    scored = _scored(spark, d) if scored is None else scored
    return model.with_band(scored, F.broadcast(model.residual_bands(scored, p="p_challenger")), p="p_challenger")  # a row per block


@query
def band_rows(spark, d):
    return rounded(_banded(spark, d).select("key", "y", "lo", "hi"), 3)


# evaluation


@query
def segment_errors(spark, d):
    return rounded(evaluate.segment_errors(_scored(spark, d)), 3)


@query
def coverage(spark, d):
    return rounded(_banded(spark, d).groupBy("hub").agg(evaluate.coverage(F.col("y"), F.col("lo"), F.col("hi")).alias("coverage")), 3)


@query
def pinball(spark, d):
    return rounded(_banded(spark, d).groupBy("hub").agg(evaluate.pinball(F.col("y"), F.col("lo"), F.col("hi")).alias("pinball")), 3)


def _psi(spark, d, names: list[str]) -> DataFrame:
    events = a.table(spark, d, "events").withColumns({"n": F.datediff("ts", F.lit(a.FIRST_DAY)), "k": F.get_json_object("props", "$.k").cast("double")})
    rows = events.filter((F.col("n") >= SPLIT - REFERENCE) & (F.col("n") < MONITOR_FROM)).withColumns({"one": F.lit(1.0), "k": F.when(F.col("n") >= SPLIT, F.col("k") * 2).otherwise(F.col("k"))})
    return rounded(evaluate.psi(rows, names, F.col("n") < SPLIT))


@query
def psi_features(spark, d):
    return _psi(spark, d, ["value", "user_id", "k", "one"])


def _differences(spark, d, scored: DataFrame | None = None) -> DataFrame:
    diff = F.abs(F.col("y") - F.col("p_challenger")) - F.abs(F.col("y") - F.col("p_champion"))
    return (_scored(spark, d) if scored is None else scored).select("key", "block", "hub", diff.alias("diff"))


@query
def paired_bootstrap(spark, d):
    """Bands of 2,000 draws with weights that SQL can follow."""
    bands = bootstrap.bands_by_digests(_differences(spark, d), draws=2000)
    return bands.withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(fixed(F.col(c), 3)) for c in ("lo", "hi")})


@query
def paired_bootstrap_bands(spark, d):
    return bootstrap.bands(_differences(spark, d), draws=2000)


# gate


def _daily_rows(rows: DataFrame) -> DataFrame:
    """Published rows with a few conflicting copies."""
    copies = rows.filter("dayofmonth(day) % 7 = 3 and hour in (5, 6)").withColumns({"price_rt": F.when(F.col("hour") == 5, F.col("price_rt") + 3).otherwise(F.col("price_rt")), "seq": F.col("seq") + (1 << 40)})
    return rows.unionByName(copies)


@dataclass(frozen=True)
class DailyRuns:
    """A run for each day: its rows with their reasons, the different accepted ones, and the hour counts, each stored once."""

    marked: DataFrame
    exact: DataFrame
    counts: DataFrame
    hourly: DataFrame


def _runs(spark, d) -> DailyRuns:
    f = a.stored_feeds(spark, d)
    marked = stored(contract.with_reason(_daily_rows(f.preliminary), a.EVENTS).withColumn("run_id", F.col("day").cast("string")), "marked")
    exact = stored(reconcile.exact_rows(marked.filter("reason is null")).withColumn("run_id", F.col("day").cast("string")), "exact")
    counts = stored(reconcile.interval_counts(exact.filter("place = 1"), list(a.EVENTS.hubs)).withColumn("run_id", F.col("day").cast("string")), "counts")
    return DailyRuns(marked, exact, counts, f.hourly)


def _summary(runs: DailyRuns) -> DataFrame:
    """The counters of every daily run, as one row each."""
    rates = contract.quarantine_rate(runs.marked, "run_id").select("run_id", F.col("rate").alias("quarantine_rate"))
    clash = runs.exact.groupBy("run_id").agg(F.count(F.when((F.col("key_rows") > 1) & (F.col("place") == 1), 1)).alias("duplicate_conflicts"))
    wrong = runs.counts.groupBy("run_id").agg(F.count(F.when(~F.col("ok"), 1)).alias("hour_count_days_wrong"))
    gap = reconcile.revision_gap(runs.exact.filter("place = 1"), runs.hourly, TOLERANCE, by="run_id").filter("run_id is not null")
    gap = gap.select("run_id", F.col("share_off").alias("reconcile_share_off"), F.col("mean_abs").alias("reconcile_mean_abs"))
    return rates.join(clash, "run_id", "left").join(wrong, "run_id", "left").join(gap, "run_id", "left")


DATA_CHECKS = ["quarantine_rate", "hour_count_days_wrong", "duplicate_conflicts", "reconcile_share_off", "reconcile_mean_abs"]


def _values(runs: DailyRuns) -> DataFrame:
    return rounded(gate.values(_summary(runs), DATA_CHECKS))


def _results(spark, d, runs: DailyRuns | None = None) -> DataFrame:
    """The results of all runs, stored, as verdicts and notes read them more than once."""
    return stored(gate.results(_values(runs or _runs(spark, d)), DAILY.frame(spark)), "results")


@query
def gate_values(spark, d):
    return _values(_runs(spark, d))


@query
def gate_results(spark, d):
    return _results(spark, d)


@query
def gate_by_run(spark, d):
    return gate.verdicts(_results(spark, d))


@query
def gate_report(spark, d):
    """One JSON text per run, as the report sink writes it."""
    result = _results(spark, d)
    return gate.report(result, gate.verdicts(result)).select("run_id", F.to_json(F.struct("checks", "passed", "total", "exit_code")).alias("report"))


@query
def report_sink(spark, d):
    """The reports as JSON files, read back: verdict and what failed of each run."""
    result, path = _results(spark, d), new_folder(spark, "reports")
    files.write_report(gate.report(result, gate.verdicts(result)), path)
    rows = spark.read.schema("run_id string, passed long, total long, exit_code long, checks array<struct<check: string, passed: boolean, value: double>>").json(path)
    failed = F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["check"]), ",")
    return rows.select("run_id", "passed", "total", "exit_code", failed.alias("failed"), fixed(F.aggregate("checks", F.lit(0.0), lambda s, c: s + F.coalesce(c["value"], F.lit(0.0))), 3).alias("values"))


def _candidate(spark, d, scored: DataFrame, bands: DataFrame) -> DataFrame:
    """The model checks of one run: errors, coverage and drift on the lines of orders and events."""
    edges = bands.agg(F.max(F.when(F.col("kind") == "overall", F.col("hi"))).alias("overall_improvement"), F.max(F.when(F.col("segment") == "R", F.col("lo"))).alias("peak_no_regression"), F.max(F.when(F.col("kind") == "hub", F.col("lo"))).alias("hub_no_regression"))
    cover = _banded(spark, d, scored).agg(evaluate.coverage(F.col("y"), F.col("lo"), F.col("hi")).alias("band_coverage"))
    drift = _psi(spark, d, ["value", "user_id"]).agg(F.max("psi").alias("psi_max"))
    one = edges.join(F.broadcast(cover)).join(F.broadcast(drift)).withColumn("run_id", F.lit("candidate"))  # single rows
    names = ["overall_improvement", "peak_no_regression", "hub_no_regression", "band_coverage", "psi_max"]
    checks = gate.Suite(checks=tuple(c for c in gate.CHECKS if c[0] in names)).frame(spark)
    return rounded(gate.results(gate.values(one, names), checks), 3)


@query
def candidate_gate(spark, d):
    """The model checks with bands of 16 draws that SQL can follow: a check of weights and rules, not a release decision."""
    scored = _scored(spark, d)
    return _candidate(spark, d, scored, bootstrap.bands_by_digest(_differences(spark, d, scored), draws=16))


@query
def candidate_gate_bands(spark, d):
    """The release decision: the model checks with bands of the suite's draws."""
    suite, scored = gate.Suite(), _scored(spark, d)
    return _candidate(spark, d, scored, bootstrap.bands(_differences(spark, d, scored), draws=suite.draws, seed=suite.seed))


# releases: all checks of many runs at once

RELEASE = gate.Suite(
    checks=tuple(c if c[0] != "quarantine_rate" else (c[0], c[1], c[2], 0.02, 0.02, c[5]) for c in gate.CHECKS),  # a hub-day is a larger part of this feed
    split_day=SPLIT, monitor_from_day=MONITOR_FROM, reference_days=REFERENCE,
)


def _release(spark, d) -> release.Release:
    """A clean run, one for each defect, and one whose copies and units are off: every check fails somewhere."""
    f = a.release_feeds(spark, d)
    run = lambda df, name: df.withColumn("run_id", F.lit(name))
    first = F.date_add(F.lit(a.FIRST_DAY).cast("date"), SPLIT)
    off = f.rows.withColumns({"price_rt": F.when(F.col("hour") % 10 == 0, F.col("price_rt") + 8).otherwise(F.col("price_rt")), "unit": F.when((F.col("hub") == HUB) & (F.dayofmonth("day") < 6), "USD/kWh").otherwise(F.col("unit"))})
    injected = {name: defects.inject(f.rows, name, HUB, DAY) for name in defects.ROW_DEFECTS}
    rows = a.union([run(df, name) for name, df in ({"clean": f.rows, "copies_off": off, "load_units": f.rows, "skew": f.rows} | injected).items()])
    loads = run(defects.forecast_unit_change(f.forecasts, first), "load_units")
    others = f.forecasts.withColumn("run_id", F.explode(F.array(*[F.lit(n) for n in ("clean", "copies_off", "skew", *injected)])))
    return release.decide(rows, f.revisions, others.unionByName(loads), RELEASE, a.TYPES, a.FIRST_DAY, skewed=("skew",), keep=stored)


@query
def release_checks(spark, d):
    """All ten checks of every run."""
    return rounded(_release(spark, d).results(RELEASE), 3)


@query
def release_data(spark, d):
    """The numbers of the five data checks of every run."""
    return rounded(gate.values(_release(spark, d).summary(RELEASE), DATA_CHECKS), 4)


@query
def release_matrix(spark, d):
    """The checks that each seeded defect fails, against those it must fail."""
    return defects.matrix(stored(_release(spark, d).results(RELEASE), "results"))


@query
def release_evidence(spark, d):
    """What a person looks at, for every failed check of every run."""
    made = _release(spark, d)
    return notes.evidence(stored(made.results(RELEASE), "results"), made.evidence(RELEASE))


@query
def release_report(spark, d):
    """Verdict and failed checks of every run."""
    results = stored(_release(spark, d).results(RELEASE), "results")
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return gate.verdicts(results).join(results.groupBy("run_id").agg(failed.alias("failed")), "run_id")


def _fits_by_run(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = a.run_predictions(spark, d)
    sums = model.grouped_sums(rows, _columns(CHALLENGER), F.col("y"), ["run_id"])
    return rows, model.fit_by_run(sums, tuple(CHALLENGER), {"champion": tuple(CHAMPION), "challenger": tuple(CHALLENGER)}, ["run_id"])


def _scored_by_run(spark, d) -> DataFrame:
    rows, fits = _fits_by_run(spark, d)
    return model.predict_by_run(rows, stored(fits, "fits"), {"champion": _columns(CHAMPION), "challenger": _columns(CHALLENGER)}, ["run_id"])


@query
def run_sums(spark, d):
    """Means and products of deviations, from which the models of every run are solved."""
    sums = model.grouped_sums(a.run_predictions(spark, d), _columns(CHALLENGER), F.col("y"), ["run_id"])
    names = ["x1x1", "x1x2", "x1y", "x2x2", "x2y"]
    per = [F.col("products")[k] / F.col("n") for k in range(len(names))]
    return rounded(sums.select("run_id", "n", *[F.col("means")[k].alias(f"mean_{c}") for k, c in enumerate(("x1", "x2", "y"))], *[p.alias(n) for p, n in zip(per, names, strict=True)]), 3)


@query
def run_models(spark, d):
    """Champion and challenger of every run, from one aggregate."""
    long = _fits_by_run(spark, d)[1].select("run_id", "model", "intercept", F.explode(F.arrays_zip("features", "mean", "scale", "coef")).alias("z"))
    return rounded(long.select("run_id", "model", F.col("z.features").alias("feature"), "z.mean", "z.scale", "z.coef", "intercept"), 3)


@query
def run_errors(spark, d):
    return rounded(evaluate.segment_errors(_scored_by_run(spark, d), by=("run_id",)), 3)


@query
def run_residual_bands(spark, d):
    return rounded(model.bands_by_run(_scored_by_run(spark, d), ["run_id"], p="p_challenger"), 3)


@query
def run_bands(spark, d):
    """Bands of 2,000 draws of every segment of every run, in one pass."""
    diff = F.abs(F.col("y") - F.col("p_challenger")) - F.abs(F.col("y") - F.col("p_champion"))
    return bootstrap.bands(_scored_by_run(spark, d).select("run_id", "key", "block", "hub", diff.alias("diff")), 2000, by="run_id")


@query
def run_psi(spark, d):
    """Stability of value and user_id of each type of event, the types as runs."""
    n = F.datediff("ts", F.lit(a.FIRST_DAY))
    rows = a.table(spark, d, "events").filter((n >= SPLIT - REFERENCE) & (n < MONITOR_FROM)).select(F.col("event_type").alias("run_id"), n.alias("n"), "value", "user_id")
    return rounded(evaluate.psi(rows, ["value", "user_id"], F.col("n") < SPLIT, by=("run_id",)))


# monitoring


def _daily(spark, d) -> DataFrame:
    return monitor.daily_mae(a.daily_scored(spark, d), by=["series"])


def _band(daily: DataFrame) -> DataFrame:
    return monitor.control_band(daily.filter(F.datediff("day", F.lit(a.FIRST_DAY).cast("date")) < SPLIT), ["series"], days=14)


def _outside(spark, d) -> DataFrame:
    daily = _daily(spark, d)
    # a narrower band than in production, so that days fall outside
    band = _band(daily)
    mid = (F.col("band_lo") + F.col("band_hi")) / 2
    narrow = band.select("series", (mid - (mid - F.col("band_lo")) / 4).alias("band_lo"), (mid + (F.col("band_hi") - mid) / 4).alias("band_hi"))
    return monitor.outside(rounded(daily), rounded(narrow), ["series"])


@query
def monitor_daily(spark, d):
    return rounded(_daily(spark, d))


@query
def monitor_band(spark, d):
    return rounded(_band(_daily(spark, d)))


@query
def monitor_streak(spark, d):
    return monitor.streaks(_outside(spark, d), ["series"])


@query
def monitor_trigger(spark, d):
    return monitor.triggers(_outside(spark, d), ["series"])


# defects


def _injected(spark, d) -> DataFrame:
    rows = a.complete_rows(spark, d)
    return a.union([defects.inject(rows, name, HUB, DAY).withColumn("defect", F.lit(name)) for name in defects.ROW_DEFECTS])


@query
def defect_rows(spark, d):
    return _injected(spark, d).drop("seq")


@query
def defect_forecast(spark, d):
    return rounded(defects.forecast_unit_change(a.forecasts(spark, d), DAY))


@query
def defect_matrix(spark, d):
    c = contract.Contract(hubs=tuple(a.TYPES))
    key, values = ["defect", *reconcile.KEY], reconcile.VALUES
    marked = stored(contract.with_reason(_injected(spark, d), c).withColumn("run_id", F.col("defect")), "marked")
    rates = contract.quarantine_rate(marked, "run_id").select("run_id", F.col("rate").alias("quarantine_rate"))
    exact = stored(reconcile.exact_rows(marked.filter("reason is null"), key, values), "exact")
    clash = exact.groupBy(F.col("defect").alias("run_id")).agg(F.count(F.when((F.col("key_rows") > 1) & (F.col("place") == 1), 1)).alias("duplicate_conflicts"))
    hubs = a.union([spark.createDataFrame([(n, t) for n in defects.ROW_DEFECTS for t in a.TYPES], "defect string, hub string")]).select(F.concat_ws("/", "defect", "hub").alias("hub"))
    counts = reconcile.interval_counts(exact.filter("place = 1").withColumn("hub", F.concat_ws("/", "defect", "hub")), hubs)
    wrong = counts.groupBy(F.split_part("hub", F.lit("/"), F.lit(1)).alias("run_id")).agg(F.count(F.when(~F.col("ok"), 1)).alias("hour_count_days_wrong"))
    summary = rates.join(clash, "run_id").join(wrong, "run_id")
    checked = gate.values(summary, ["quarantine_rate", "hour_count_days_wrong", "duplicate_conflicts"])
    return defects.matrix(stored(gate.results(checked, DEFECT_SUITE.frame(spark)), "results"))


# notes


@query
def diagnose_runs(spark, d):
    return notes.diagnose(_results(spark, d))


@query
def run_evidence(spark, d):
    runs = _runs(spark, d)
    days = reconcile.wrong_days(runs.counts).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("hub", "hours_seen", "hours_expected"))).alias("evidence"))
    marked = runs.marked.filter("reason is not null").groupBy("run_id", "reason").agg(F.count("*").alias("n"))
    reasons = marked.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("evidence"))
    return notes.evidence(_results(spark, d, runs), {"hour_count_days_wrong": days, "quarantine_rate": reasons})


FORM = notes.NoteForm(
    held="status: hold, {bad} of {total} checks out of bounds", cause="cause: {check} in {family}, measured {value}, bound {op} {limit}",
    effects="effects: {list}", effect="{check} {value} (bound {op} {limit})", no_effects="effects: none", seen="seen: {list}", nothing_seen="seen: only the figures above",
    action="action: {list}", actions={"data_quality": "load this day again", "integrity": "find the second writer of {check}"}, any_action="ask whoever runs {check}",
    decides="status changes: by a person", passed=("status: pass, {total} checks within bounds", "cause: none", "action: none"),
)


def _notes(spark, d) -> DataFrame:
    runs = _runs(spark, d)
    facts = reconcile.wrong_days(runs.counts).select("run_id", F.lit("hour_count_days_wrong").alias("check"), F.col("hub").alias("ord"), F.format_string("%s shows %d of %d hours", "hub", "hours_seen", "hours_expected").alias("fact"))
    return notes.template_notes(_results(spark, d, runs), FORM, facts)


@query
def note_template(spark, d):
    return _notes(spark, d)


def _allowed(spark, d) -> DataFrame:
    summary = stored(_summary(_runs(spark, d)), "summary")
    checked = gate.values(summary, ["reconcile_share_off", "reconcile_mean_abs", "quarantine_rate"]).withColumn("value", fixed(F.col("value"), 9))
    whole = summary.select("run_id", F.col("duplicate_conflicts").alias("value"))
    return notes.allowed_numbers(checked, checked.select("run_id", F.col("run_id").alias("text")).distinct(), whole)


@query
def allowed_numbers(spark, d):
    return _allowed(spark, d)


def _documents(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = a.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run_id"), F.col("doc_id").alias("note_id"), F.col("text").alias("note"), "n_chars")
    numbers = docs.select("run_id", F.explode(F.array("note_id", "n_chars")).alias("value"))
    return docs.drop("n_chars"), notes.allowed_numbers(numbers.filter("false").withColumn("value", F.col("value").cast("double")), whole=numbers)


@query
def note_filter(spark, d):
    docs, allowed = _documents(spark, d)
    return notes.filter_notes(docs, allowed).select("note_id", "ok", "reasons")


@query
def note_fallback(spark, d):
    docs, allowed = _documents(spark, d)
    templates = docs.select("run_id", F.concat(F.lit("Template of run "), "run_id").alias("note"))
    return notes.with_fallback(notes.filter_notes(docs, allowed), templates).groupBy("source", "ok").agg(F.count("*").alias("n"), F.sum(F.length("note").cast("long")).alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """For each hub: the share of hours in which the two hourly copies differ by more than the tolerance."""
    return hourly_copies(spark, d)
