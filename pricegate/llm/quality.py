"""Regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the model is fitted on (those with the least hash of doc_id).
FIT_ROWS = 20_000
#: Weight of the pooled covariance, and of the diagonal, in a class covariance; least variance.
POOLED, DIAGONAL, FLOOR = 0.4, 0.2, 1e-3
#: Share of the smaller class is counted as this at least.
LEAST_PRIOR = 0.02
#: Words added to every text's number, so that traits of short texts are drawn towards none.
SMALL = 10
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_CLASSES = {"upper": re.compile(r"[A-ZÀ-ÖØ-Þ]"), "digit": re.compile(r"[0-9]"), "mark": re.compile(r"[^\w\s.,;:'\"()?-]"), "stop": re.compile(r"[.,;:?]")}
FEATURES = ["words", "word_length", "upper", "digit", "mark", "stop", "marked_words", "shouted_words", "lone_marks", "repeated_words", "repeated_lines", "line_words", "not_letters", "echoes"]


def _share(x: float, n: float) -> float:
    """Log-odds of a share, drawn in by half a unit of a hundred, so that an absent trait stays finite."""
    p = x / max(n, 1)
    return math.log((p + 0.01) / (1.01 - min(p, 1.0)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of FEATURES; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), len(text)
    size = sum(map(len, words))
    count = {k: len(p.findall(text)) for k, p in _CLASSES.items()}
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    letters = sum(map(str.isalpha, words))
    lone = sum(len(w) == 1 and not w.isalnum() for w in words)
    w, c = n + SMALL, size + 5 * SMALL  # so that a share of a few words says little
    return [
        math.log1p(n), math.log1p((size + 5 * SMALL) / w), _share(count["upper"], c), _share(count["digit"], c), _share(count["mark"], c), _share(count["stop"], w),
        _share(sum(x[-1] in "*#$%&!|@~^" for x in words), w), _share(sum(x.isupper() and len(x) > 1 for x in words), w), _share(lone, w),
        _share(n - len(set(words)), w), _share(len(lines) - len(set(lines)), len(lines) + 5), math.log1p(n / (len(lines) + 1)), _share(n - letters, w),
        _share(sum(map(str.__eq__, words, words[1:])), w),
    ]


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of two classes; larger class index: label 1."""

    means: np.ndarray
    factors: np.ndarray  # inverses of the lower Cholesky factors
    offsets: np.ndarray  # log prior less half the log determinant
    centre: np.ndarray
    scale: np.ndarray
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: logistic of the tempered log-density difference."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [self.offsets[k] - 0.5 * ((z - self.means[k]) @ self.factors[k].T).__pow__(2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0]) * self.temper, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Class covariances shrunk towards the pooled one and its diagonal. A class without rows takes the pooled mean."""
    centre, scale = (x.mean(0), np.maximum(x.std(0), 0.05)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.clip((x - centre) / scale, -8, 8)
    p = x.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    means = np.array([a.mean(0) if len(a) else np.zeros(p) for a in parts])
    own = [(a - m).T @ (a - m) for a, m in zip(parts, means, strict=True)]
    pooled = sum(own) / max(len(z) - 2, 1)
    factors, offsets = [], []
    for a, s in zip(parts, own, strict=True):
        c = (1 - POOLED) * s / max(len(a) - 1, 1) + POOLED * pooled if len(a) > p else pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(p)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        prior = min(max(len(a) / max(len(z), 1), LEAST_PRIOR), 1 - LEAST_PRIOR)
        offsets.append(math.log(prior) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets), centre, scale, 1 / math.sqrt(p))


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("name"), b.column("quality"), x], ["name", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """Fits on at most ``rows`` labelled documents that are not held out.

    Labels with nulls or other values than 0 and 1 are passed over; of several labels of a
    document the least counts, and of several rows of a document the one with the least
    statistics. So the sample is bounded and always the same; its labels may be broadcast and
    its statistics brought to the driver.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("name"), "quality", "text")
    found = texts.mapInArrow(_features, "name string, quality int, x array<double>").groupBy("name").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("name")
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, found["quality"].to_numpy(dtype=int))


def score(text: Column, model: Discriminant) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row.

    Null and empty texts get the score of their statistics, all counts zero. Without usable
    labels both classes look alike and every score is 0.5.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted 1, each by its own text alone.

    A null text is scored as an empty one; rows of equal texts stay or go together, whatever
    their ids; a score of exactly 0.5 stays. An empty table gives no rows; without usable
    labels all stay.
    """
    return docs.filter(score(F.col("text"), train(docs, labels)) >= 0.5)
