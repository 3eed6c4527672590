"""Long words of the merge model: many merges at a time give what one at a time gives."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricegate.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def one_at_a_time(m, word, key):
    """The best candidate of the whole word in turn, the leftmost of equals."""
    ids = [int(m.char[ord(c)]) for c in word]
    at = list(range(len(ids)))
    while len(ids) > 1:
        rank, made, base = m.candidates(np.array(ids[:-1]), np.array(ids[1:]), np.array(at[:-1]))
        if m.dropout > 0:
            rank = np.where(m.skipped(key, base), pieces.NONE, rank)
        k = int(rank.argmin())
        if rank[k] == pieces.NONE:
            break
        ids[k : k + 2], at[k : k + 2] = [int(made[k])], [at[k]]
    return ids


def some_words():
    rng = random.Random(1)
    kinds = ["abcdefgh", "-=_*#ab", "thequickbrownfoxingationer", "abc", "-", "中文字符没有空格的"]
    words = ["".join(rng.choice(k) for _ in range(rng.randint(2, 120))) for k in kinds for _ in range(40)]
    return [*words, "bccca", *["-" * n for n in range(65, 100)], "ab" * 100, "aab" * 70, "==--" * 50, "0123456789" * 20, " " * 90 + "x", "é" * 70, "\n-" * 40, "x"]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_long_words(dropout):
    m, words = pieces.Merges(MODEL, dropout, 7), some_words()
    keys = np.random.default_rng(3).integers(0, 1 << 63, len(words), dtype=np.uint64)
    for w, k, got in zip(words, keys, m.long(words, keys), strict=True):
        assert got.tolist() == one_at_a_time(m, w, k), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdehnorst-=. "), min_size=1, max_size=60), min_size=1, max_size=5), st.integers(0, 2**63))
def test_any_words(words, seed):
    m = pieces.merges(MODEL, 0.2, 7)
    keys = pieces.mixed(np.arange(len(words), dtype=np.uint64) + np.uint64(seed))
    assert [x.tolist() for x in m.long(words, keys)] == [one_at_a_time(m, w, k) for w, k in zip(words, keys, strict=True)]


def test_without_dropout_ids_are_the_models_own():
    import sentencepiece

    model, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Merges(MODEL, 0.0, 7)
    texts = ["中文字符没有空格" * 500, "-" * 5000, "=-" * 3000, "".join(random.Random(2).choice("thequickbrownfox") for _ in range(20_000))]
    assert [x.tolist() for x in m.encode(texts, ["a"] * 4)] == model.encode(texts)


def test_long_words_take_no_long_time():
    """1 MB each of texts without spaces, rules of dashes, tokens of 100 characters, and one word; some 1.5 s of CPU each on a busy machine."""
    rng = random.Random(4)
    letters = "thequickbrownfoxingationer"
    texts = ["中文字符没有空格" * 42_000, ("-" * 79 + "\n") * 12_500, " ".join("".join(rng.choice(letters + "XYZ0123456789") for _ in range(100)) for _ in range(10_000)), "".join(rng.choice(letters) for _ in range(1_000_000))]
    m = pieces.Merges(MODEL, 0.1, 7)
    for t in texts:
        began = time.process_time()
        ids = m.encode([t], ["x"])[0]
        assert time.process_time() - began < 5 and m.decode(ids.tolist()) == t


def test_decode_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (2, []), (None, None)], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in pieces.decode(df, MODEL).collect()) == [(0, ""), (1, ""), (2, ""), (2, "")]
