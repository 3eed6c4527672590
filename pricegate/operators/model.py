"""Ridge models from sums of one pass, and their empirical bands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import quantiles


@dataclass(frozen=True)
class Ridge:
    """A fitted model: a handful of numbers, small enough to travel in a plan."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def predict(self, design: dict[str, Column]) -> Column:
        """The linear expression over design columns; other names than the fitted ones are an error."""
        if tuple(design) != self.names:
            raise ValueError(f"features {tuple(design)} are not those fitted: {self.names}")
        out = F.lit(self.intercept)
        for x, m, s, b in zip(design.values(), self.mean, self.scale, self.coef, strict=True):
            out = out + (x - F.lit(m)) / F.lit(s) * F.lit(b)
        return out

    def frame(self, spark: SparkSession, model: str) -> DataFrame:
        rows = [(model, n, m, s, b, self.intercept) for n, m, s, b in zip(self.names, self.mean, self.scale, self.coef, strict=True)]
        return spark.createDataFrame(rows, "model string, feature string, mean double, scale double, coef double, intercept double")


@dataclass(frozen=True)
class Sums:
    """What a ridge fit needs of the rows: means, covariances of the predictors, and theirs with y."""

    names: tuple[str, ...]
    n: int
    start: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    xy: np.ndarray

    def ridge(self, names: tuple[str, ...] | None = None, alpha: float = 1.0) -> Ridge:
        """A fit on all or some of the predictors."""
        names = names or self.names
        k = [self.names.index(x) for x in names]
        gram, xy, p = self.gram[np.ix_(k, k)], self.xy[k], len(k)
        mean = self.first + self.start
        scale = np.sqrt(np.maximum(np.diag(gram), 0))
        scale = np.where(scale < 1e-12 * np.maximum(1, np.abs(mean[k])), 1.0, scale)
        coef = np.linalg.solve(self.n * gram / np.outer(scale, scale) + alpha * np.eye(p), self.n * xy / scale)
        return Ridge(tuple(names), tuple(map(float, mean[k])), tuple(map(float, scale)), tuple(map(float, coef)), float(mean[-1]))


def sums(rows: DataFrame, design: dict[str, Column], y: Column) -> Sums:
    """One aggregate of n, sums and products, taken about the first row so that large levels do not drown the
    variances; p (p + 3) / 2 numbers reach the driver."""
    names, p = tuple(design), len(design)
    plain = rows.select(*[x.cast("double").alias(f"x{k}") for k, x in enumerate(design.values())], y.cast("double").alias("y"))
    start = plain.first()
    if start is None:
        raise ValueError("no rows to fit on")
    z = [F.col(f"x{k}") - F.lit(start[k]) for k in range(p)] + [F.col("y") - F.lit(start[p])]
    products = [F.sum(z[i] * z[j]) for i in range(p) for j in range(i, p + 1)]
    n, *found = plain.agg(F.count("*"), *[F.sum(a) for a in z], *products).first()
    first, second = np.array(found[: p + 1]) / n, np.zeros((p, p + 1))
    second[[i for i in range(p) for _ in range(i, p + 1)], [j for i in range(p) for j in range(i, p + 1)]] = found[p + 1 :]
    cov = second / n - np.outer(first[:p], first)
    return Sums(names, n, np.array([*start], dtype=float), first, np.triu(cov[:, :p]) + np.triu(cov[:, :p], 1).T, cov[:, p])


def fit(rows: DataFrame, design: dict[str, Column], y: Column, alpha: float = 1.0) -> Ridge:
    """Ridge on columns standardised by the population deviation (0 counts as 1); the intercept is the mean of y. The driver solves p equations."""
    return sums(rows, design, y).ridge(alpha=alpha)


def grouped_sums(rows: DataFrame, design: dict[str, Column], y: Column, by: list[str]) -> DataFrame:
    """What fits need of each run's rows: by, n, means (of the predictors and y), and products of the deviations from them,
    predictor by predictor and with y, row by row of the upper triangle. Two aggregates, whatever the number of runs."""
    p = len(design)
    names = [f"__x{k}" for k in range(p)] + ["__y"]
    plain = rows.select(*by, *[x.cast("double").alias(n) for n, x in zip(names, [*design.values(), y], strict=True)])
    means = plain.groupBy(*by).agg(F.array(*[F.avg(n) for n in names]).alias("means"))
    z = [F.col(n) - F.col("means")[k] for k, n in enumerate(names)]
    products = F.array(*[F.sum(z[i] * z[j]) for i in range(p) for j in range(i, p + 1)])
    return plain.join(means, by).groupBy(*by, "means").agg(F.count("*").alias("n"), products.alias("products")).select(*by, "n", "means", "products")


def fit_by_run(sums: DataFrame, names: tuple[str, ...], models: dict[str, tuple[str, ...]], by: list[str], alpha: float = 1.0) -> DataFrame:
    """by, model, n, features, mean, scale, coef, intercept: each run's models on some of the predictors, from its sums (a row per run)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(names)
        upper = [(i, j) for i in range(p) for j in range(i, p + 1)]
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                means, square = np.array(row.means, float), np.zeros((p, p + 1))
                square[tuple(np.array(upper).T)] = np.array(row.products, float) / row.n
                gram = np.triu(square[:, :p]) + np.triu(square[:, :p], 1).T
                held = Sums(names, row.n, np.zeros(p + 1), means, gram, square[:, p])
                for model, some in models.items():
                    r = held.ridge(some, alpha)
                    out.append((*(getattr(row, c) for c in by), model, row.n, list(r.names), list(r.mean), list(r.scale), list(r.coef), r.intercept))
            yield pd.DataFrame(out, columns=[*by, "model", "n", "features", "mean", "scale", "coef", "intercept"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by]
    return sums.mapInPandas(run, ", ".join([*kinds, "model string, n long, features array<string>, mean array<double>, scale array<double>, coef array<double>, intercept double"]))


def predict_by_run(rows: DataFrame, fits: DataFrame, designs: dict[str, dict[str, Column]], by: list[str]) -> DataFrame:
    """``rows`` with a prediction p_<model> for each model, by its run's coefficients, a row per run that is joined; rows of runs without a fit are left out.

    ``designs``: of each model the columns it was fitted on, in that order.
    """
    held = fits.groupBy(*by).pivot("model", list(designs)).agg(F.first(F.struct("mean", "scale", "coef", "intercept")))
    held = held.select(*by, *[F.col(m).alias(f"__{m}") for m in designs])
    out = rows.join(held, by)
    for m, design in designs.items():
        part = lambda name, m=m: F.col(f"__{m}.{name}")
        p = part("intercept")
        for k, x in enumerate(design.values()):
            p = p + (x - part("mean")[k]) / part("scale")[k] * part("coef")[k]
        out = out.withColumn(f"p_{m}", p)
    return out.drop(*[f"__{m}" for m in designs])


def bands_by_run(scored: DataFrame, by: list[str], block: str = "block", y: str = "y", p: str = "p", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """band_lo and band_hi of each run and block in one aggregate, in which the rows of a run's block meet: those of a window of hours."""
    q = F.percentile(F.col(y) - F.col(p), [low, high])
    return scored.groupBy(*by, block).agg(q.alias("q")).select(*by, block, F.col("q")[0].alias("band_lo"), F.col("q")[1].alias("band_hi"))


def residual_bands(scored: DataFrame, by: str = "block", y: str = "y", p: str = "p", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """band_lo and band_hi: exact quantiles of y - p by block; a row per block."""
    return quantiles(scored, [by], F.col(y) - F.col(p), [low, high]).select(by, F.col("q")[0].alias("band_lo"), F.col("q")[1].alias("band_hi"))


def with_band(scored: DataFrame, bands: DataFrame, by: str | list[str] = "block", p: str = "p") -> DataFrame:
    """Rows with lo and hi about their prediction."""
    return scored.join(bands, by, "left").withColumns({"lo": F.col(p) + F.col("band_lo"), "hi": F.col(p) + F.col("band_hi")}).drop("band_lo", "band_hi")
