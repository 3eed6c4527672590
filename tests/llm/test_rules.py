"""Counts of the quality rules against brute force, the trees' constraints, and held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricegate.llm import boosting, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside)]


TEXTS = [
    None, "", " \n\t", "a\n\na\na \nb", "one two three four five one two three four five", "x " * 9, "x " * 40, "é　ß \x85 \x1c z\xa0", "a|b <c> #*$%&", "line\nline\r\nline\n \n \n",
    "a b c d e f " * 3 + "unique words follow here", "lorem ipsum dolor " * 30_000, " ".join(f"w{k}" for k in range(500)),
]


def test_counts():
    assert rules.measured(TEXTS)[0].tolist() == [brute(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\r#|é\x85　"), max_size=60), min_size=1, max_size=6))
def test_any_counts(texts):
    assert rules.measured(texts)[0].tolist() == [brute(t) for t in texts]


def test_equal_hashes_do_not_count(monkeypatch):
    """With a hash that says nothing, the words themselves still decide."""
    monkeypatch.setattr(rules, "_R", np.zeros(rules.SPAN + 1, np.uint64))
    assert rules.measured(TEXTS[3:11])[0].tolist() == [brute(t) for t in TEXTS[3:11]]


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) - 0.5 * x[:, 2] + rng.normal(size=4000) > 0).astype(int)
    trees = boosting.fit(x, y, np.array([1, -1, 0]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75
    grid = np.linspace(-4, 4, 81)
    for f, sign in ((0, 1), (1, -1)):
        rows = np.repeat(x[:200], len(grid), 0)
        rows[:, f] = np.tile(grid, 200)
        assert (sign * np.diff(trees.raw(rows).reshape(200, -1), axis=1) >= -1e-12).all()
    free = boosting.fit(x, y, np.zeros(3))
    rows = np.repeat(x[:200], len(grid), 0)
    rows[:, 1] = np.tile(grid, 200)
    assert np.diff(free.raw(rows).reshape(200, -1), axis=1).max() > 0.5  # what the constraint holds back


def test_flat_trees_score_as_walked():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4)).round(1)
    t = boosting.fit(x, (x[:, 0] * x[:, 1] > 0).astype(int), np.zeros(4), trees=9)

    def walked(row):
        total = t.bias
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return total

    assert np.allclose(t.raw(x), [walked(r) for r in x])
    assert len(t.roots) == 9 and ((t.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.95


@pytest.mark.parametrize("y", [[], [1] * 50, [0] * 50])
def test_one_class(y):
    t = boosting.fit(np.zeros((len(y), 2)), np.array(y, int), np.zeros(2))
    s = t.score(np.array([[0.0, 9.0]]))[0]
    assert s == 0.5 if not y else (s > 0.9 if y[0] else s < 0.1)


def test_apply(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).withColumns({"n_words": F.lit(1), "kept": F.lit("x"), "score": F.lit(0), "quality": F.lit(1)})
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    rows = sorted(rules.apply(df, labels).collect(), key=lambda r: r["doc_id"])
    assert [list(r)[1:6] for r in rows] == [brute(t) for t in TEXTS]
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] <= (not r["base_failed"])
    odd = spark.createDataFrame([(None, "a " * 12), (5, "plain words"), (5, None)], "doc_id long, text string")
    assert rules.apply(odd, labels).count() == 3
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.apply(df, labels.filter("false")).collect())
    assert rules.apply(df.filter("false"), labels).count() == 0 and rules.keep(df.filter("false"), labels).columns == df.columns
    assert {r["doc_id"] for r in rules.keep(df, labels).collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_sample_bound(spark):
    """More labelled rows than the bound: the model is fitted on the bound, the same rows each time."""
    df = spark.range(0, 300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("plain words here "), F.col("id").cast("string"))).otherwise("## ## ## ##").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    one, two = rules.train(df, labels, rows=60), rules.train(df.repartition(7), labels, rows=60)
    assert one.bias == two.bias and (one.value == two.value).all() and abs(one.bias) < 1 and len(one.roots)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    got = {r["doc_id"]: r["score"] >= 0.5 for r in rules.apply(docs, labels).collect() if r["doc_id"] in want}
    assert np.mean([got[i] == (q == 1) for i, q in want.items() if i in got]) > 0.97
