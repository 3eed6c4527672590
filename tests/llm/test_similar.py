"""The pipeline's near-duplicate stage against all pairs of exact shingle similarity."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricegate.llm import simhash, similar
from pricegate.llm.common import stored
from tests.llm.test_operators import least

NEAR = dict(corpus_pipeline.STAGES)["simhash near-dedup"]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def changed(rng, text, k):
    words = text.split()
    for at in np.linspace(5, len(words) - 6, k).astype(int):
        words[at] = f"z{rng.integers(0, 1 << 40)}"
    return " ".join(words)


def test_planted_near_copies(spark):
    """Copies with 2 to 8 of 400 words changed (similarity 0.95 to 0.82) go, those with 11 (0.76) stay."""
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(30)]
    texts = [*base, *[changed(rng, b, k) for b in base[:20] for k in (2, 5, 8)], *[changed(rng, b, 11) for b in base[20:]], *[changed(rng, base[0], 3) for _ in range(80)], None, "", " ", "Two words", "two  words", "three short words"]
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(least(edges, range(len(texts))).values())
    assert set(range(20, 30)) | set(range(90, 100)) <= want and not set(range(30, 90)) & want
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, base[0], "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands string").repartition(3)
    out = NEAR(spark, df, "")
    assert out.columns == df.columns
    got = [r["doc_id"] for r in out.collect()]
    assert got.count(None) == 2 and set(got) - {None} == want and len(got) == len(want) + 2
    assert NEAR(spark, df.filter("false"), "").count() == 0


def test_repeated_ids_stay_or_go_together(spark):
    rng = np.random.default_rng(9)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (2, changed(rng, a, 3)), (2, b), (3, changed(rng, b, 3))], "doc_id long, text string")
    assert [r["doc_id"] for r in NEAR(spark, df, "").collect()] == [1]


def test_fuller_bands_lose_no_link(spark, monkeypatch):
    """Chains of texts of which only neighbours are similar, all sharing bands, and small bounds: links between all components are found."""
    for name, value in (("BLOCK", 8), ("LEFT", 4), ("RIGHT", 5), ("LEFT_BYTES", 3000), ("RIGHT_BYTES", 9000)):
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(3):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        for step in range(25):  # 4 more words change with every step: similarity 0.82 to the next, 0.67 to the one after
            for at in range(4):
                words[(8 * step + 2 * at * 25) % 200] = f"z{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = least(edges, range(len(texts)))
    assert 3 <= len(set(want.values())) < 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, words=5, similarity=0.8).collect()}
    assert got == want


def all_pairs(texts):
    """Every pair of different word sequences of a similarity of 0.8 or more, by the shingles that such a pair must share among its rarest."""
    distinct = {}
    for k, t in enumerate(texts):
        distinct.setdefault(tuple((t or "").encode().lower().split()), []).append(k)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in distinct]
    count = Counter(s for x in sets for s in x)
    at, pairs = defaultdict(list), set()
    for k, x in enumerate(sets):
        listed = sorted(x, key=lambda s: (count[s], s))[: len(x) - math.ceil(0.8 * len(x)) + 1]
        near = {j for s in listed for j in at[s]}
        pairs |= {(j, k) for j in near if len(x & sets[j]) >= 0.8 * len(x | sets[j])}
        for s in listed:
            at[s].append(k)
    return list(distinct.values()), pairs


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_documents(spark, sf):
    """Against all pairs of the table: links found, and components that are the same."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    groups, pairs = all_pairs([r["text"] for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect()}
    of = [got[rows[g[0]]["doc_id"]] for g in groups]
    assert len(pairs) >= 5 and sum(of[a] == of[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = least([(a, b) for a, b in pairs], range(len(groups)))
    same = defaultdict(set)
    for k, component in want.items():
        same[component].add(of[k])
    assert len(set(of)) >= len(same)  # nothing is linked that should not be
    assert sum(len(s) == 1 for s in same.values()) >= 0.99 * len(same)


def test_the_grid_of_simhashes_proposes_pairs(spark):
    """Where no two texts share a band of least hashes, those whose SimHashes the grid links are found, and no others."""
    rng = np.random.default_rng(12)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 1500)) for _ in range(12)]
    texts = [*base, *(changed(rng, b, k) for b in base for k in (1, 2, 4))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sketches = similar.sketched(df, "text", 5)
    apart = sketches.withColumn("bands", F.transform("bands", lambda b: F.xxhash64(b, F.col("doc_id"))))
    rows = {r["doc_id"]: r for r in sketches.collect()}
    sets = [shingles(t) for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if bin((rows[a]["simhash"] ^ rows[b]["simhash"]) & (1 << 64) - 1).count("1") <= simhash.NEAR]
    assert len(close) >= 5 and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in close)
    got = [(r["a"], r["b"]) for r in similar.similar_pairs(df, stored(apart, "sketches"), simhash.close_pairs, "text", 5, 0.8).collect()]
    number = {r["fp"]: k for k, r in rows.items()}
    assert least([(number[a], number[b]) for a, b in got], range(len(texts))) == least(close, range(len(texts)))


def test_texts_whose_simhashes_lie_apart_are_no_pair():
    same, marks = np.zeros((3, 100), np.uint8), np.array([0, (1 << similar.RADIUS) - 1, (1 << 64) - 1], dtype=np.uint64)
    assert [p[:2] for p in similar.spanning(same, marks, 0.66)] == [(1, 0)]
