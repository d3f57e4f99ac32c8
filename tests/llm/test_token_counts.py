"""Prefix token counts against the library's own encoding of every prefix."""
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
from cohortlens.llm import token_counts
from cohortlens.llm.queries import op12_token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [" ", "  ", "\n", "\n\n", "\t", " \n ", " ", "  ", "\u0085", "\x1c", "​", "'re", "'ve", "'ll", "'s", "'l", "'r", "'", "'reader", "!!'ll",
       "<|endoftext|>", "<|endo", "|>", "two", "Ünïté", "two's", "12", "3,5", "½", "两只老虎", "é́", "🙂", "👩‍👩‍👧", "----------", "=" * 70, "aaaaaaaaaaaaaaaa", "THE", "\0"]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ODD + [cases.prose(rng, 3) for _ in range(10)]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(open(FILE, encoding="utf-8").read())


def n_tokens(library, text: str) -> int:
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_librarys_count(library, counter):
    for text in [*ODD, *texts(150, 1), "a <|endoftext|><|endoftext|> b", "x  <|endoftext|>", " " * 200, "ha" * 300]:
        width, steps = counter.steps(text)
        assert counter.steps_of([text]) == [(width, steps)]
        want = [n_tokens(library, text[:end]) for end in range(1, len(text) + 1)]
        assert token_counts.counts_of(width, steps).tolist() == want, text


def test_white_space_is_the_librarys(library):
    """Units start at white space only where the library sees white space too."""
    space = re.compile(f"[{token_counts.SPACE}]")
    for code in [*range(0xD800), *range(0xE000, 0x11000), 0x1F642, 0xE0020]:
        pieces = library.pre_tokenizer.pre_tokenize_str(f"a{chr(code) * 2}b")  # only white space is cut between two equal characters
        assert bool(space.match(chr(code))) == any(end == 2 for _, (_, end) in pieces), hex(code)


def test_steps_that_need_more_than_a_byte(counter, library, monkeypatch):
    text = "--- two words"
    plain = token_counts.counts_of(*counter.steps(text)).tolist()
    fresh = token_counts.PrefixCounter(open(FILE, encoding="utf-8").read())
    packed = token_counts.packed
    monkeypatch.setattr(token_counts, "packed", lambda steps: token_counts.Wide(steps) if len(steps) in (3, 4) else packed(steps))
    width, steps = fresh.steps(text)
    assert width == 4 and token_counts.counts_of(width, steps).tolist() == plain


def test_budget_and_counts_at(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(60, 2))] + [(None, "two words"), (70, None), (71, ""), (71, "")]
    counts = token_counts.prefix_counts(cases.documents(spark, rows), FILE)
    fits = {(r.doc_id, r.n_chars, r.n_bytes): r for r in token_counts.budget(counts, 7).collect()}
    for i, t in rows:
        t = t or ""
        r = fits[i, len(t), len(t.encode())]
        within = [e for e in range(len(t) + 1) if n_tokens(library, t[:e]) <= 7]
        assert (r.n_tokens, r.over_limit, r.fit_chars) == (n_tokens(library, t), n_tokens(library, t) > 7, max(within)), t
        assert r.fit_tokens == n_tokens(library, t[:r.fit_chars])
    half = token_counts.count_at(counts.withColumn("at", F.floor(F.col("n_chars") / 2)), "at").where("doc_id < 60").collect()
    by_id = dict(rows)
    assert all(r.tokens_at == n_tokens(library, by_id[r.doc_id][:r.at]) for r in half) and len(half) == 60


def test_registered_query(spark, library, tmp_path):
    rows = cases.awkward_texts()
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = cases.as_rows(op12_token_counts(spark, str(tmp_path)), ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    want = [(i, len((t or "").encode()), n_tokens(library, t or ""), n_tokens(library, t or "") > 512) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_empty_table_and_other_tokenizers(spark):
    assert token_counts.budget(token_counts.prefix_counts(cases.documents(spark, []), FILE), 5).count() == 0
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
