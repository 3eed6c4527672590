"""Quality rules: counts of whole texts, plain limits on them, and boosted trees for what the limits let through."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .quality import FIT_ROWS, held_out

#: Words of a window that is looked for again; least words of a text; most repeated words in a hundred.
SPAN, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Characters of texts that are measured at a time.
AT_ONCE = 1_000_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that the trees look at, and of which of them a text may only get worse (-1) or better (1) by having more.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "duplicate_lines": -1, "repeated_words": -1, "upper": -1, "digits": 0, "marks": -1, "stops": 0, "quotes": 0, "beyond_ascii": 0,
    "different_words": 1, "echoes": -1, "lone_marks": -1, "line_words": 0,
}
SIGNS = np.array(list(FEATURES.values()))
_R = np.random.default_rng(11).integers(0, 1 << 63, SPAN + 1, dtype=np.uint64) | np.uint64(1)


def _bytes(characters: str) -> list[int]:
    return list(characters.encode())


def repeated_windows(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of SPAN words that its text holds twice or more. ``ids``: of words, ``doc``: of their texts, in order."""
    n = len(ids) - SPAN + 1
    inside = np.zeros(len(ids), bool)
    if n <= 0:
        return inside
    start = np.flatnonzero(doc[:n] == doc[SPAN - 1 :])
    h = (doc[start].astype(np.uint64) + np.uint64(1)) * _R[SPAN]
    for k in range(SPAN):
        x = (ids[start + k].astype(np.uint64) + np.uint64(1)) * _R[k]
        h += (x ^ (x >> np.uint64(29))) * _R[(k + 1) % SPAN]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    likely = np.zeros(len(start), bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    start = start[likely]
    if len(start):  # equal hashes only propose; the words themselves decide
        rows = np.stack([doc[start], *(ids[start + k] for k in range(SPAN))], 1)
        order = np.lexsort(rows.T)
        same = (rows[order[1:]] == rows[order[:-1]]).all(1)
        sure = np.zeros(len(start), bool)
        sure[order[1:][same]] = sure[order[:-1][same]] = True
        for k in range(SPAN):
            inside[start[sure] + k] = True
    return inside


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measured(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of whole texts, null as empty: the counts BASE, and the statistics FEATURES."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    held = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raw])
    words = [r.split() for r in raw]  # at \x20 and \x09-\x0D
    n = np.array(list(map(len, words)))
    known: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((i for ws in words for i in map(known.__getitem__, ws)), np.int64, n.sum())
    lone = np.fromiter((len(w) == 1 and not w.isalnum() for w in known), bool, len(known))
    doc = np.repeat(np.arange(len(raw)), n)
    per = lambda flags, of=doc: np.bincount(of, flags, minlength=len(raw)).astype(np.int64)
    repeated = per(repeated_windows(ids, doc))
    echo = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    different = np.bincount(np.unique(doc << 40 | ids) >> 40, minlength=len(raw))
    space = held[:, _bytes(" \t\n\x0b\x0c\r")].sum(1)
    chars = held.sum(1) - held[:, 0x80:0xC0].sum(1) - space
    symbols = held[:, _bytes("#*$%&|<>")].sum(1)
    repeats = np.array(list(map(duplicate_lines, raw)))
    base = np.stack([n, chars, symbols, repeats, repeated], 1)
    w, c = n + 10, chars + 50  # so that a trait of a few words says little
    lines = held[:, 10] + 1
    share = lambda listed, of: held[:, listed].sum(1) / of
    features = np.stack([
        np.log1p(n), (chars + 50) / w, symbols / w, repeats / (lines + 5), repeated / w, share(range(65, 91), c), share(range(48, 58), c), share(_bytes("!?@^~_=+\\{}[]|`"), w), share(_bytes(".,;:"), w),
        share(_bytes("'\"()-"), w), share(range(0xC0, 0x100), c), (different + 10) / w, per(echo, doc[1:]) / w, per(lone[ids]) / w, np.log1p(n / lines),
    ], 1)
    return base, features


def _in_parts(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Measures some texts at a time, AT_ONCE characters or one text."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= AT_ONCE:
            yield measured(part)
            part, size = [], 0
    if part:
        yield measured(part)


def _all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_in_parts(texts))
    if not parts:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def base_failed(base: np.ndarray) -> np.ndarray:
    words, repeated = base[:, 0], base[:, 4]
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> boosting.Trees:
    """Trees grown on at most ``rows`` labelled documents that are not held out.

    Labels with nulls or other values than 0 and 1 are passed over; of several labels of a
    document the least counts, and of several rows of a document the least statistics.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _all(b.column("text"))[1]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["name", "quality", "x"])

    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("name"), "quality", "text")
    found = texts.mapInArrow(run, "name string, quality int, x array<double>").groupBy("name").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("name")
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return boosting.fit(x, found["quality"].to_numpy(dtype=int), SIGNS)


SCHEMA = ", ".join([*(f"{c} long" for c in BASE), "base_failed boolean", "kept boolean", "score double"])


def judge(docs: DataFrame, trees: boosting.Trees, text: str = "text") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its counts, whether they break a limit, the trees' score, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, x = _all(b.column("text"))
            score, failed = trees.score(x), base_failed(base)
            columns = [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every row.

    Words are what stands between ASCII white space. ``n_repeat_words`` counts the words that
    lie in a window of five words which the text holds twice or more. A text of less than ten
    words, or with more than a fifth of its words repeated, fails; of the others the trees
    keep those with a score of one half or more, which more symbols, repetitions, capitals
    and marks can only lower. Null texts count as empty and fail. Rows that repeat a doc_id,
    or have none, are judged each by its own text. Without usable labels the trees keep all.
    An empty table gives no rows.
    """
    return judge(docs, train(docs, labels))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept, each by its own text alone."""
    trees = train(docs, labels)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        base, x = _all(pa.array(texts))
        return pd.Series(~base_failed(base) & (trees.score(x) >= 0.5))

    return docs.filter(kept(F.col("text")))
