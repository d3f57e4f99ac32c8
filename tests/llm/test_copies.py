"""Exact and near duplicates, repeated passages, against brute force on awkward rows."""
import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import components, exact_dedup, near_dedup, substring_dedup
from cohortlens.llm.common import prepare

import cases


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return cases.documents(spark).cache()


@pytest.mark.parametrize("k", [1, 4, 1024])
def test_exact_verdicts_whatever_the_number_of_counters(docs, k):
    got = cases.as_rows(exact_dedup.exact_dedup(docs, k=k), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
    assert got == cases.copies(cases.awkward_texts())


def test_exact_keeps_one_row_per_group_with_all_columns(docs):
    left = exact_dedup.keep_first_copies(docs)
    want = Counter(v[1] for v in {v[4]: v for v in cases.copies(cases.awkward_texts())}.values())
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == want


def test_summary_holds_every_frequent_digest():
    rng = random.Random(1)
    stream = ["hot"] * 300 + ["warm"] * 120 + [str(rng.random()) for _ in range(580)]
    rng.shuffle(stream)
    summary: Counter = Counter()
    for at in range(0, len(stream), 50):
        summary = exact_dedup.merge_summary(summary, Counter(stream[at:at + 50]), 9)
    assert {"hot", "warm"} <= set(summary) and len(summary) <= 9
    assert 300 - len(stream) / 10 <= summary["hot"] <= 300


@pytest.mark.parametrize("words", [2, 5])
def test_near_components(docs, words):
    rows = cases.awkward_texts()
    got = near_dedup.near_duplicates(docs, words=words).collect()
    want = cases.near_components(rows, words)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    sizes = Counter((i, len(cases.shingles(t, words))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    nulls = {r["n_shingles"]: r["component_id"] for r in got if r["doc_id"] is None}
    assert nulls == {0: None, len(cases.shingles(rows[6][1], words)): want[7]}


def test_near_components_with_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    got = near_dedup.near_duplicates(docs, words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == cases.near_components(cases.awkward_texts(), 2)


def test_near_keeps_columns(docs):
    left = near_dedup.keep_representatives(docs)
    assert left.columns == docs.columns
    want = cases.near_components(cases.awkward_texts(), 5)
    assert {r["doc_id"] for r in left.collect()} - {None} == {i for i, c in want.items() if i == c}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for share in (0.5, 0.8, 0.95):
        cut = int(len(a) * share * 2 / (1 + share))
        b = np.concatenate([a[:cut], rng.integers(0, 1 << 63, len(a) - cut, dtype=np.uint64)])
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        assert (near_dedup.merge(x, y) == near_dedup.registers(np.concatenate([a, b]))).all()
        assert abs(near_dedup.estimate(x, y, len(a), len(b)) - share) < 0.1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(200, 200), (301, 300), (301, 300)]
    got = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}
    assert {r["vertex"]: r["component"] for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("hot", [0, 3, 512])
def test_repeated_passages(spark, hot):
    rows = [r for r in dict(cases.awkward_texts()).items()]
    got = substring_dedup.remove_repeats(cases.documents(spark, rows), hot=hot).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == cases.repeats(rows)
    assert len(got) == len(rows)


def test_repeated_rows_of_one_document_are_kept_alike(spark):
    text = cases.prose(random.Random(2), 50)
    got = substring_dedup.remove_repeats(cases.documents(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 50)]


def test_automaton_statistics_against_search():
    rng = random.Random(4)
    automaton, text = substring_dedup.SuffixAutomaton(), [rng.choice("abc") for _ in range(120)]
    for w in text:
        automaton.extend(w)
    probe = [rng.choice("abcd") for _ in range(80)]
    joined = "".join(text)
    for at, size in enumerate(automaton.statistics(probe)):
        want = max(n for n in range(at + 2) if "".join(probe[at + 1 - n:at + 1]) in joined)
        assert size == want


def test_empty_tables(spark):
    none = cases.documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first_copies(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_window_anchors_are_the_leftmost_least_grams():
    import numpy as np
    import xxhash

    from cohortlens.llm.common import word_hashes
    from cohortlens.llm.substring_dedup import window_anchors

    words = [b"a", b"", "ü".encode(), b"word"]
    assert word_hashes(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and len(word_hashes([])) == 0
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 6, 19, 20, 21, 60, 300):
        for window, gram in ((20, 6), (7, 6), (6, 6), (13, 4)):
            grams, at = window_anchors(rng.integers(0, 3, n).astype(np.uint64), window, gram)
            width = window - gram + 1
            assert at.tolist() == [i + int(np.argmin(grams[i:i + width])) for i in range(len(grams) - width + 1)]
