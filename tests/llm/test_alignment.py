"""Cross-tokenizer alignment against brute force."""

import base64
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricegate.llm import alignment

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "  two  spaces \n\n and\ttabs ", "don't stop", "a▁b", "naïve café 中文字符没有空格 ﬁ é́ 　x\xa0y z", "<|endoftext|> <s>x</s>", "\x00zero\x1cunit", "tail ", "tail\n", "\nhead",
    "-" * 500, "x7Qz" * 200, "🙂🙃 emoji 👩‍👩‍👧", "the cat sat on the mat. The cat's mat!\nSat the cat?", "the cat sat on the mat. The cat's mat!\nSat the cat?", "internationalization of words " * 40, "中" * 300, "word\r\nnext\x0bline",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def groups_of(text, libraries):
    """The groups of a whole text as (ids of A, ids of B): cut where tokens of both end; None without tokens."""
    a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode_ordinary(" " + text), b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
    bytes_a = [a.decode_single_token_bytes(i) for i in ids_a]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    out, start = [], 0
    for c in cuts:
        out.append(([i for i, e in zip(ids_a, ends_a, strict=True) if start < e <= c], [i for i, e in zip(ids_b, ends_b, strict=True) if start < e <= c]))
        start = c
    return out


def brute(texts, libraries):
    groups = [groups_of(t, libraries) for t in texts]
    count = Counter(p for g in groups if g for p in {(x, y) for a, b in g for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for g in groups:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in g for x in a for y in b]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha256(shown.encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))]


def test_align(spark, libraries, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).withColumns({"pair": F.lit(1), "block": F.lit("x"), "n": F.lit(2)})
    assert found(alignment.align(df, RANKS, MODEL)) == brute(TEXTS, libraries)
    monkeypatch.setattr(alignment, "BLOCK", 100)  # blocks of a few texts, the same results
    monkeypatch.setattr(alignment, "ROWS", 2)
    assert found(alignment.align(df.coalesce(1), RANKS, MODEL)) == brute(TEXTS, libraries)


def test_odd_ids_and_empty(spark, libraries):
    rows = [(None, "one two"), (2**60 + 1, "one two"), (2**60 + 1, "three"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_a"], r["count_sum"]) for r in alignment.align(df, RANKS, MODEL).collect()), key=str)
    want = sorted(((i, b[0], b[5]) for (i, _), b in zip(rows, brute([t for _, t in rows], libraries), strict=True)), key=str)
    assert got == want
    assert alignment.align(df.filter("false"), RANKS, MODEL).count() == 0


def test_corpus(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert found(alignment.align(docs, RANKS, MODEL)) == brute(texts, libraries)


def test_link_table(spark, libraries):
    texts = ["the cat", "the cats", "internationalization", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = Counter(p for t in texts if t for p in {(x, y) for a, b in groups_of(t, libraries) for x in a for y in b})
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.link_table(df, RANKS, MODEL).collect()}
    assert got == {p: (n, n == max(m for q, m in count.items() if q[0] == p[0])) for p, n in count.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x1c 　▁.,'-aeinorst中é🙂0") | st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_any_text(libraries, texts):
    made = alignment.links(RANKS, MODEL)
    block = alignment.Block(0, made)
    block.add(list(range(len(texts))), texts)
    want = brute(texts, libraries)
    assert [(*row[:4], row[4]) for row in block.rows] == [(*w[:4], w[6]) for w in want]


def test_union_find():
    rng = np.random.default_rng(2)
    for n in (1, 5, 200):
        a, b = rng.integers(0, n, (2, n // 2))
        up = list(range(n))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = up[x], up[y]
            up = [min(x, y) if u in (x, y) else u for u in up]
        assert alignment.union_find(n, a, b).tolist() == up
    assert alignment.union_find(20_000, np.arange(19_999), np.arange(1, 20_000)).max() == 0
