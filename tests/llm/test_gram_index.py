"""The flat gram index of the decontamination: exact under hash collisions, of bounded size."""
import pickle
import random

import numpy as np
import pytest

import cases
from cohortlens.llm import decontam


def plain_spans(items, words, n=13):
    out = set()
    for item, text in items:
        w = decontam.benchmark_words(text)
        size = min(n, len(w))
        grams = {tuple(w[a:a + size]) for a in range(len(w) - size + 1)} if w else set()
        out |= {(a, a + size, item) for a in range(len(words) - size + 1) if tuple(words[a:a + size]) in grams}
    return out


@pytest.mark.parametrize("values", [1, 3, None])
def test_verified_even_if_hashes_collide(monkeypatch, values):
    if values:
        whole = decontam.ngram_hashes
        monkeypatch.setattr(decontam, "ngram_hashes", lambda hashes, n: whole(hashes, n) % np.uint64(values))
    rng = random.Random(3)
    few = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(25)]
    items = [(i % 20, t) for i, t in enumerate(few)] + [(50, None), (51, "?!"), (52, "a " * 60)]
    index = decontam.gram_index(items)
    for text in [*few, "a " * 30, "c", "", "b a " * 20]:
        words = decontam.benchmark_words(text)
        found = decontam.find_spans(index, words) if words else []
        assert {(a, b, i) for a, b, ids in found for i in ids} == plain_spans(items, words)


def test_a_repeated_gram_is_held_once():
    codes, item, _ = decontam.gram_index([(1, "a " * 5000), (2, "a " * 50)]).grams[13]
    assert len(codes) == 2 and sorted(item.tolist()) == [0, 1]


@pytest.mark.parametrize("text", [cases.prose(random.Random(1), 60_000), "".join(chr(97 + random.Random(i).randrange(26)) + " " for i in range(60_000))])
def test_size_bound(text):
    items = [(i, text[at:at + 3000]) for i, at in enumerate(range(0, len(text), 3000))]
    assert len(pickle.dumps(decontam.gram_index(items))) <= 11 * len(text.encode()) + 10_000


def test_no_items():
    assert decontam.find_spans(decontam.gram_index([]), [b"a"]) == []
