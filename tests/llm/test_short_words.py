"""Words that the merge model remembers, and their occurrences that skip merges."""

import random

import numpy as np
import public_tokenizers
import pytest

from pricegate.llm import pieces

from .test_long_words import one_at_a_time

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def some_texts(number, words):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 20))) for _ in range(5_000)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(number)]


def test_occurrences_that_skip_are_merged_together():
    """The numpy work is shared by all words of a batch: its calls depend on the lengths of words, not on how many ways they go."""
    m, calls = pieces.Merges(MODEL, 0.1, 7), []
    find = m.find
    m.find = lambda pair: calls.append(len(pair)) or find(pair)
    texts = some_texts(100, 300)
    found = m.encode(texts, [str(k) for k in range(100)])
    assert [m.decode(ids.tolist()) for ids in found] == texts
    assert len(calls) < 500  # 197; 942 when each way was looked up and remembered


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_all_lengths_side_by_side(dropout):
    """Words of any length up to the remembered one and beyond, so that shorter ones stand beside longer ones."""
    rng = random.Random(6)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in range(1, pieces.LONG + 4) for letters in ("thequickbrownfox", "a-", "éß中😀ab\n▁")]
    texts = [" ".join(words), " ".join(reversed(words)), "", " ", "x  ", "", words[0]]
    m, names = pieces.Merges(MODEL, dropout, 7), ["a", "b", "c", "d", "e", "f", ""]
    for _ in range(2):  # remembered or not
        for t, name, ids in zip(texts, names, m.encode(texts, names), strict=True):
            own = pieces._WORD.findall(" " + t) if t else []
            keys = m.occurrence_keys([name], np.array([len(own)]))
            assert ids.tolist() == [i for w, k in zip(own, keys, strict=True) for i in m.spelled(np.array(one_at_a_time(m, w, k)))[0]]


def test_results_do_not_depend_on_what_is_remembered(monkeypatch):
    texts, names = some_texts(30, 100), [str(k) for k in range(30)]
    whole = [x.tolist() for x in pieces.Merges(MODEL, 0.1, 7).encode(texts, names)]
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    monkeypatch.setattr(pieces, "SIDE", 100)
    m = pieces.Merges(MODEL, 0.1, 7)
    assert whole == [m.encode([t], [n])[0].tolist() for t, n in zip(texts, names, strict=True)]


def test_words_are_those_of_the_expression():
    texts = ["", " ", "  a b  ", "x\n y\t", "\ud800 é", "", "b a", "▁ 中", "\x00"]
    words, which, number = pieces._words(texts)
    assert [words[k] for k in which] == [w for t in texts if t for w in pieces._WORD.findall(" " + t)]
    assert number.tolist() == [len(pieces._WORD.findall(" " + t)) if t else 0 for t in texts] and len(set(words)) == len(words)
    assert pieces._words([])[0] == [] and pieces._words(["", ""])[2].tolist() == [0, 0]
