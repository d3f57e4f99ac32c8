"""Ranked search against scores of all documents in plain Python."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import cases
from cohortlens.llm import lexical_search as ls
from cohortlens.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(cases.lower(text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


COLUMNS = ["item_id", "rank", "doc_id", "score"]


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id bigint, text string, SCORE int, doc_id string")


def queries():
    rng = random.Random(4)
    rows = cases.awkward_texts()
    items = [(n, cases.prose(rng, rng.randint(1, 30))) for n in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere!"), (33, "ka ka KA kaben Solo"), (34, "it's 12 o'clock"), (35, rows[11][1][:4000]), (36, "两 只"), (None, "solo")]
    return rows, items


@pytest.mark.parametrize("limits", [{}, {"BLOCK_DOCS": 7, "LEAF": 0}, {"BLOCK_POSTINGS": 40, "LEAF": 3, "SHALLOW_SPLITS": 1}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ls, name, value)
    rows, items = queries()
    got = ls.search(cases.documents(spark, rows), items_frame(spark, items), 10)
    assert cases.as_rows(got, COLUMNS) == brute(rows, items)


def test_registered_query_and_item_blocks(spark, tmp_path):
    rows, items = queries()
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    items_frame(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, items)
    assert cases.as_rows(op11_lexical_search(spark, str(tmp_path)), COLUMNS) == want
    in_blocks = ls.search(cases.documents(spark, rows), items_frame(spark, items), 10, item_bytes=600)
    assert cases.as_rows(in_blocks, COLUMNS) == want


def test_a_hot_passage_with_ties(spark):
    """Half of all documents hold the searched passage: ties go to the lowest ids."""
    rng = random.Random(9)
    passage = cases.prose(rng, 12)
    rows = [(i, passage if i % 2 else cases.prose(rng, 12)) for i in range(600)]
    items = [(0, passage)]
    got = cases.as_rows(ls.search(cases.documents(spark, rows), items_frame(spark, items), 10), COLUMNS)
    assert got == brute(rows, items) and [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 20, 2))


def test_range_maxima():
    rng = np.random.default_rng(3)
    term_of, doc_of = np.nonzero(rng.random((6, 90)) < 0.5)
    block = ls.Block(doc_of, term_of, rng.integers(1, 9, len(doc_of)), np.full(90, 100), np.array([5, 0, 900, 7000, 20, 1]))
    for term in range(6):
        low, high = block.first[term], block.first[term + 1]
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                assert block.impact[block.maxima(np.array([a]), np.array([b]))[0]] == block.impact[a:b].max()


def test_long_documents_use_exact_integers():
    lengths = np.array([10**9, 3], np.int64)
    assert ls.length_factors(lengths, 10**10, 7 * 10**12).tolist() == [25 + 75 * n * 10**10 // (7 * 10**12) for n in (10**9, 3)]


def test_empty_tables(spark):
    rows, items = queries()
    assert ls.search(cases.documents(spark, []), items_frame(spark, items)).count() == 0
    assert ls.search(cases.documents(spark, rows), items_frame(spark, [])).count() == 0
