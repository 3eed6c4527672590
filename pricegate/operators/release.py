"""The whole release decision for many runs at once: from published rows to the numbers of all checks, keyed by run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bootstrap, contract, evaluate, features, gate, model, reconcile

RUN = "run_id"


@dataclass(frozen=True)
class Release:
    """What the checks read of every run, a table each."""

    marked: DataFrame
    exact: DataFrame
    counts: DataFrame
    gaps: DataFrame
    fits: DataFrame
    errors: DataFrame
    bands: DataFrame
    coverage: DataFrame
    psi: DataFrame

    def summary(self, suite: gate.Suite) -> DataFrame:
        """A row per run with the number of each check; null where it cannot be told, as without drift features or a peak."""
        only = lambda c, v: F.max(F.when(c, F.col(v)))
        rate = contract.quarantine_rate(self.marked, RUN).select(RUN, F.col("rate").alias("quarantine_rate"))
        clash = self.exact.groupBy(RUN).agg(F.count(F.when((F.col("key_rows") > 1) & (F.col("place") == 1), 1)).alias("duplicate_conflicts"))
        wrong = self.counts.groupBy(RUN).agg(F.count(F.when(~F.col("ok"), 1)).alias("hour_count_days_wrong"))
        gap = self.gaps.select(RUN, F.col("share_off").alias("reconcile_share_off"), F.col("mean_abs").alias("reconcile_mean_abs"))
        kind, segment = F.col("kind"), F.col("segment")
        edges = self.bands.groupBy(RUN).agg(only(kind == "overall", "hi").alias("overall_improvement"), only((kind == "block") & (segment == "peak"), "lo").alias("peak_no_regression"), only(kind == "hub", "lo").alias("hub_no_regression"))
        drift = self.psi.filter(F.col("feature").isin(*suite.drift_features)).groupBy(RUN).agg(F.max("psi").alias("psi_max"))
        out = rate
        for part in (clash, wrong, gap, edges, self.coverage.select(RUN, F.col("coverage").alias("band_coverage")), drift):
            out = out.join(part, RUN, "left")
        return out

    def results(self, suite: gate.Suite) -> DataFrame:
        names = [c[0] for c in gate.CHECKS]
        return gate.results(gate.values(self.summary(suite), names), suite.frame(self.marked.sparkSession))

    def evidence(self, suite: gate.Suite) -> dict[str, DataFrame]:
        """For each check a table (run_id, evidence): what a person looks at if it fails."""
        listed = lambda rows, *names: rows.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("evidence"))
        one = lambda rows, *names: rows.select(RUN, F.struct(*names).alias("evidence"))
        reasons = self.marked.filter("reason is not null").groupBy(RUN, "reason").agg(F.count("*").alias("n"))
        clash = self.exact.groupBy(RUN).agg(F.count(F.when((F.col("key_rows") > 1) & (F.col("place") == 1), 1)).alias("conflicting_keys"))
        gap = one(self.gaps.withColumn("tolerance", F.lit(suite.tolerance)), F.col("n").alias("reconciled_hours"), "tolerance")
        segments = self.errors.join(self.bands, [RUN, "kind", "segment"]).withColumn("evidence", F.struct(F.col("segment").alias("name"), "n", "mae_champion", "mae_challenger", "diff", "lo", "hi"))
        worst = segments.filter("kind = 'hub'").groupBy(RUN).agg(F.max_by("evidence", F.struct("lo", "segment")).alias("evidence"))
        drift = self.psi.groupBy(RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi")))).alias("evidence"))
        return {
            "hour_count_days_wrong": listed(reconcile.wrong_days(self.counts), "hub", "day", "hours_seen", "hours_expected"),
            "quarantine_rate": reasons.groupBy(RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("evidence")),
            "duplicate_conflicts": one(clash, "conflicting_keys"), "reconcile_share_off": gap, "reconcile_mean_abs": gap,
            "overall_improvement": segments.filter("kind = 'overall'").select(RUN, "evidence"), "peak_no_regression": segments.filter("kind = 'block' and segment = 'peak'").select(RUN, "evidence"),
            "hub_no_regression": worst, "band_coverage": one(self.coverage, "coverage"), "psi_max": drift,
        }


def decide(
    rows: DataFrame, revisions: DataFrame, forecasts: DataFrame, suite: gate.Suite, hubs: list[str], first_day: str, limits: contract.Contract | None = None, skewed: tuple[str, ...] = (),
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> Release:
    """Every step of the gate for all runs of ``rows`` and ``forecasts`` (which have a run_id; ``revisions`` hold for all).

    One aggregate fits both models of every run, and one joined table scores them; nothing is
    done run by run. ``keep`` stores what several steps read (a table, a name); without it,
    Spark works it out anew for each. In ``skewed`` runs serving lost the squared price.
    """
    by, key = (RUN,), [RUN, *reconcile.KEY]
    marked = keep(contract.with_reason(rows, limits or contract.Contract(hubs=tuple(hubs))), "marked")
    exact = keep(reconcile.exact_rows(marked.filter("reason is null"), key), "exact")
    clean = exact.filter("place = 1").select(*key, *reconcile.VALUES)
    counts = keep(reconcile.interval_counts(clean, hubs, by=by), "counts")
    final = reconcile.apply_revisions(clean, revisions)
    gaps = reconcile.revision_gap(clean, final, suite.tolerance, key, by=RUN).filter(F.col(RUN).isNotNull())
    window = features.windows(F.lit(first_day).cast("date"), suite.split_day, suite.monitor_from_day, suite.reference_days)
    rows = keep(features.build(final, clean, forecasts, by=by).withColumn("window", window), "features")
    designs = {"champion": features.design(hubs), "challenger": features.design(hubs, True)}
    train = F.col("window.name") == "train"
    names = {m: tuple(d) for m, d in designs.items()}
    sums = model.grouped_sums(rows.filter(train), designs["challenger"], F.col("y"), [RUN])
    fits = keep(model.fit_by_run(sums, names["challenger"], names, [RUN]), "fits")
    served = dict(designs["challenger"], da_sq=F.when(F.col(RUN).isin(*skewed), F.lit(0.0)).otherwise(designs["challenger"]["da_sq"])) if skewed else designs["challenger"]
    test = model.predict_by_run(rows.filter("window.name = 'test'"), fits, designs | {"challenger": served}, [RUN])
    # bands are of what the model was fitted to, whatever serving does
    fitted = model.predict_by_run(rows.filter(train), fits, designs, [RUN])
    scored = keep(model.with_band(test, model.bands_by_run(fitted, [RUN], p="p_challenger"), [RUN, "block"], "p_challenger"), "scored")
    diff = F.abs(F.col("y") - F.col("p_challenger")) - F.abs(F.col("y") - F.col("p_champion"))
    bands = bootstrap.bands(scored.select(RUN, F.concat_ws("|", *reconcile.KEY).alias("key"), "block", "hub", diff.alias("diff")), suite.draws, suite.seed, RUN)
    held = rows.filter("window.reference or window.name = 'test'")
    return Release(
        marked, exact, counts, keep(gaps, "gaps"), fits, keep(evaluate.segment_errors(scored, by=by), "errors"), keep(bands, "bands"),
        scored.groupBy(RUN).agg(evaluate.coverage(F.col("y"), F.col("lo"), F.col("hi")).alias("coverage"), evaluate.pinball(F.col("y"), F.col("lo"), F.col("hi")).alias("pinball")),
        keep(evaluate.psi(held, features.NUMERIC, F.col("window.reference"), by=by), "psi"),
    )
