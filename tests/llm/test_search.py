"""Ranked search against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricegate.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=50):
    held = [(i, Counter(words(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, ws in asked.items():
        scored = []
        for doc_id, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in ws if w in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


DOCS = [
    (0, "The cat. THE Cat, the café"), (1, None), (2, ""), (3, "...!?"), (4, "Été été ÉTÉ İstanbul K"), (2**60 + 1, "cat dog"), (None, "cat dog"), (-5, "cat dog"), (-5, "cat dog"), (7, "dog " * 500 + "cat"),
    (8, "a_b-c a b\xa0c"), *[(100 + k, f"word{k % 7} cat filler" + " more" * (k % 13)) for k in range(200)],
]
ITEMS = [(1, "cat the cat"), (2, "dog"), (2, "more dog"), (None, "été"), (3, None), (4, ""), (5, "unseen words"), (6, "a b c word3 filler more"), (7, "istanbul K k")]


def frames(spark, docs=DOCS, items=ITEMS):
    extra = {"window": F.lit(1), "term": F.lit("x"), "score": F.lit(0), "rank": F.lit(0)}
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(extra), spark.createDataFrame(items, "item_id long, text string").withColumns(extra)


def test_search(spark):
    assert got(search.rank_documents(*frames(spark))) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("window, occurrences, rows", [(3, 10**6, 10**6), (1 << 14, 40, 10**6), (16, 10**6, 4)])
def test_small_windows_and_passes(spark, monkeypatch, window, occurrences, rows):
    """Windows that end by documents or by their words, and items searched for in several passes."""
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "OCCURRENCES", occurrences)
    monkeypatch.setattr(search, "QUERY_ROWS", rows)
    docs, items = frames(spark)
    assert got(search.rank_documents(docs.coalesce(1), items, 5)) == brute(DOCS, ITEMS, 5)


def test_empty(spark):
    docs, items = frames(spark)
    assert search.rank_documents(docs.filter("false"), items).count() == 0
    assert search.rank_documents(docs, items.filter("false")).count() == 0
    assert search.rank_documents(docs.filter("doc_id in (1, 2, 3)"), items).count() == 0


def test_hot_id_and_long_text(spark):
    """A doc_id that a third of the rows share, equal scores beyond the list's end, and a very long text."""
    docs = [(9, f"cat {k % 3}") for k in range(150)] + [(k, "cat 1") for k in range(300)] + [(1000, "cat lorem ipsum " * 60_000)]
    items = [(1, "cat 1"), (2, "lorem")]
    assert got(search.rank_documents(*frames(spark, docs, items))) == brute(docs, items)


def test_corpus(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(search.rank_documents(docs, items)) == want
