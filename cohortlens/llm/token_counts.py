"""Exact token counts at every prefix of a text, by dynamic programming over BPE prefixes.

A byte-pair encoding has the prefix property: the last token of a prefix of a piece is unique,
and a token may follow another exactly when the model encodes the two of them as just these
two. So one pass over a piece gives the last token and with it the token count of *every*
prefix: ``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that ends at ``i`` and may
follow the last token of the prefix before it. Nothing is encoded again to answer how many
tokens a prefix has or where a text must be cut to stay below a limit.

``prefix_counts`` keeps the difference of the count from one code point to the next as signed
bytes (or 32-bit integers, where a difference does not fit: column ``width``), one per code
point. ``budget`` and ``count_at`` answer from these alone. Counts need not grow with the
prefix: one more character may merge tokens, so the longest prefix within a limit is the last
position whose count is within it.

Texts are cut into units, a run of white space with the characters behind it; the byte-level
pre-tokeniser always starts a piece at a run of white space, so units are independent. A Python worker
remembers the units it has met (bounded by ``MEMO_UNITS``); a prefix that ends inside a unit
is pre-tokenised as the library does it: a run of white space at the end is one piece, a
contraction cut short is an apostrophe and a letter. Strings of special tokens inside a text
are one token, as the library treats them by default; a prefix that ends inside such a string
is ordinary text.

Defined cases: a null text is empty (no bytes, no tokens); repeated rows and null doc_ids are
counted row by row; an empty table gives an empty result; only the two named columns are read.
Tokenizers other than byte-level BPE without normaliser are refused with a ValueError.
"""
from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from operator import sub

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices
from .token_output import byte_characters

MEMO_UNITS = 800_000  # distinct units, and distinct pieces, remembered per worker
MEMO_CHARS = 64  # longer units are counted each time
MEMO_PAIRS = 2_000_000  # token pairs, and steps of the token automaton, remembered per worker

# Unicode White_Space, as a character class.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LEADING = re.compile(f"[{SPACE}]*")
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")  # of two letters: cut after the first, they are two pieces


class Wide(tuple):
    """Steps that do not fit in signed bytes."""


def packed(steps: list[int]) -> bytes | Wide:
    """Signed bytes, or wider integers where a step needs them."""
    try:
        return array("b", steps).tobytes()
    except OverflowError:
        return Wide(steps)


def joined(parts: list) -> tuple[int, bytes]:
    """(bytes per step, steps) of consecutive units."""
    try:
        return 1, b"".join(parts)
    except TypeError:  # wider integers are among them
        return 4, b"".join(np.array(p if type(p) is Wide else np.frombuffer(p, np.int8), "<i4").tobytes() for p in parts)


def counts_of(width: int, steps: bytes) -> np.ndarray:
    """Token counts of the code point prefixes 1..n."""
    return np.cumsum(np.frombuffer(steps, np.int8 if width == 1 else "<i4"), dtype=np.int64)


class PrefixCounter:
    """Token counts of all prefixes by one ``tokenizers`` file (its JSON text)."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if model.get("type") != "BPE" or not plain or odd or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level BPE without normaliser, with plain added tokens, has exact prefix counts here")
        self.alphabet = byte_characters()
        special = {t["content"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        tokenize = self.tokenizer.model.tokenize
        self.vocabulary = {t: i for t, i in model["vocab"].items() if t not in special and [x.id for x in tokenize(t)] == [i]}
        if not set(self.alphabet.values()) <= self.vocabulary.keys():
            raise ValueError("the vocabulary lacks single bytes")
        self.token = {i: t for t, i in self.vocabulary.items()}
        self.heads = {t[:k] for t in self.vocabulary for k in range(1, len(t) + 1)}
        self.moves: dict[str, tuple[str, tuple]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes | Wide] = {}
        self.memo: dict[str, bytes | Wide] = {}

    def may_follow(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = [x.id for x in self.tokenizer.model.tokenize(self.token[left] + self.token[right])] == [left, right]
            self.pairs[left, right] = known
        return known

    def _move(self, text: str) -> tuple[str, tuple]:
        """From a state and the next character: the longest ending that begins some token (the new
        state), and the tokens that end here as (length, token), longest first."""
        state = text
        while state not in self.heads:
            state = state[1:]
        tails = ((len(state) - k, self.vocabulary.get(state[k:])) for k in range(len(state)))
        if len(self.moves) >= MEMO_PAIRS:
            self.moves.clear()
        self.moves[text] = move = state, tuple((n, t) for n, t in tails if t is not None)
        return move

    def learn_pieces(self, pieces: Iterable[str]) -> None:
        """Add the steps of pre-tokens (differences of the count at their code points) to the memo.
        They are taken in sorted order, so a piece goes on from the prefix it shares with the
        one before it."""
        moves, pairs, may_follow = self.moves, self.pairs, self.may_follow
        coded = sorted((p.encode().decode("latin-1").translate(self.alphabet), p) for p in pieces)
        last, counts, states, before = [-1], [0], [""], ""
        for piece, raw in coded:
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], counts[shared + 1:], states[shared + 1:]
            before, state = piece, states[shared]
            for end in range(shared + 1, len(piece) + 1):
                ahead = state + piece[end - 1]
                state, fitting = moves.get(ahead) or self._move(ahead)
                for length, token in fitting:  # the longest is the likeliest
                    at = end - length
                    if not at or pairs.get((last[at], token)) or may_follow(last[at], token):
                        break
                last.append(token)
                counts.append(counts[at] + 1)
                states.append(state)
            if raw.isascii():
                steps = list(map(sub, counts[1:], counts))
                if raw in CUT_CONTRACTIONS:
                    steps[1:] = [2 - counts[1], counts[3] - 2]
            else:
                at_characters = [counts[e] for e in accumulate((len(c.encode()) for c in raw), initial=0)]
                steps = list(map(sub, at_characters[1:], at_characters))
            self.pieces[raw] = packed(steps)

    def _cut(self, unit: str) -> list[str]:
        """The library's pre-tokens of a unit. Letters (of the blocks up to Latin Extended-B) and
        ASCII punctuation behind them are a piece each; other units are cut by the library."""
        body = unit[1:] if unit[0] == " " else unit
        stem = body.rstrip(string.punctuation)
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
            blank = unit[:len(unit) - len(body)]
            if stem is body:
                return [unit]
            tail = body[len(stem):]
            return [blank + stem, tail]
        return [unit[start:end] for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    @staticmethod
    def _chained(parts: list) -> bytes | Wide:
        width, steps = (1, parts[0]) if len(parts) == 1 else joined(parts)
        return steps if width == 1 else Wide(np.frombuffer(steps, "<i4").tolist())

    def unit_steps(self, unit: str, cut: list[str]) -> bytes | Wide:
        """Differences of the count at the code points of a unit, from its known pieces."""
        known = self.pieces
        blanks = 1 if unit[0] == " " and unit[1:2].isalnum() else LEADING.match(unit).end()
        if blanks < 2:  # one blank counts the same alone and in front of a piece
            return self._chained([known[p] for p in cut])
        if blanks == len(unit):
            return known[unit]  # white space at the end of a text
        # a prefix of the run of white space is one piece; behind it the run's last character
        # may belong to the first piece, so the count there starts from the other pieces' sum
        run, whole = counts_of(*joined([known[unit[:blanks]]])), counts_of(*joined([known[p] for p in cut]))
        return packed(np.diff(np.concatenate([run, whole[blanks:]]), prepend=0).tolist())

    def learn(self, units: set[str]) -> dict[str, bytes | Wide]:
        """Steps of units; those of long units are returned, the others remembered."""
        memo = self.memo
        if len(memo) >= MEMO_UNITS:
            memo.clear()
        cuts = {unit: self._cut(unit) for unit in units.difference(memo)}
        pieces = set(chain.from_iterable(cuts.values()))
        pieces.update(unit[:LEADING.match(unit).end()] for unit in cuts if unit[0] != " " or unit[1:2].isspace() or len(unit) == 1)
        pieces.add(" ")
        pieces.discard("")
        if len(self.pieces) >= MEMO_UNITS:
            self.pieces.clear()
        self.learn_pieces(pieces.difference(self.pieces))
        long = {}
        for unit, cut in cuts.items():
            (memo if len(unit) <= MEMO_CHARS else long)[unit] = self.unit_steps(unit, cut)
        for piece in pieces:
            if len(piece) > MEMO_CHARS:
                self.pieces.pop(piece, None)
        return long

    def _plain(self, text: str) -> list:
        """Steps of every unit of a text without special tokens."""
        units, memo = UNITS.findall(text), self.memo
        long = self.learn(set(units))
        return [long[u] if u in long else memo[u] for u in units] if long else list(map(memo.__getitem__, units))

    def steps_of(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """``steps`` of many texts, whose units are learnt together."""
        cut = [None if self.special and self.special.search(t) else UNITS.findall(t) for t in texts]
        long = self.learn(set(chain.from_iterable(units for units in cut if units)))
        known, out = {**self.memo, **long} if long else self.memo, []
        for text, units in zip(texts, cut):
            if units is None:
                out.append(self.steps(text))
            else:
                out.append(joined([known[u] for u in units]))
        return out

    def steps(self, text: str) -> tuple[int, bytes]:
        """(bytes per step, differences of the count at every code point of ``text``)."""
        parts = self.special.split(text) if self.special else [text]
        out = self._plain(parts[0])
        for before, special, behind in zip(parts[::2], parts[1::2], parts[2::2]):
            # inside the special string a prefix is ordinary text that goes on from the last unit
            out.append(self._inside(UNITS.findall(before)[-1] if before else "", special))
            out += self._plain(behind)
        return joined(out)

    def _inside(self, unit: str, special: str) -> bytes | Wide:
        total = int(counts_of(*joined(self._plain(unit)))[-1]) if unit else 0
        counts = counts_of(*joined(self._plain(unit + special)))[len(unit):]
        counts[-1] = total + 1
        return packed(np.diff(counts, prepend=total).tolist())


def kept_counter(tokenizer_json: str) -> PrefixCounter:
    """The counter that this Python worker keeps from task to task, so that what a task has
    learnt serves the next one (a lost or new worker starts afresh)."""
    kept = sys.__dict__.setdefault("_kept_prefix_counters", {})
    name = xxhash.xxh3_128_hexdigest(tokenizer_json)
    if name not in kept:
        kept.clear()  # one tokenizer at a time
        kept[name] = PrefixCounter(tokenizer_json)
    return kept[name]


def prefix_counts(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_chars (code points), n_tokens and the steps (width, steps) per row."""
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer_json = f.read()
    PrefixCounter(tokenizer_json)  # refuses other tokenizers here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = counter.steps_of(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(s, np.int8 if w == 1 else "<i4").sum(dtype=np.int64)) for w, s in rows], pa.int64()),
                pa.array([w for w, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary()),
            ], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "width", "steps"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, width int, steps binary")


def budget(counts: DataFrame, limit: int) -> DataFrame:
    """``counts`` without its steps, with over_limit, fit_chars (code points of the longest prefix
    of at most ``limit`` tokens) and fit_tokens (that prefix's tokens)."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chars, tokens = [], []
            for total, width, steps in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
                at = counts_of(width, steps)
                within = np.flatnonzero(at <= limit) if total > limit else np.array([len(at) - 1])
                last = int(within[-1]) if len(within) else -1
                chars.append(last + 1)
                tokens.append(int(at[last]) if last >= 0 else 0)
            total = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(total > limit), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "over_limit", "fit_chars", "fit_tokens"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.select("doc_id", "n_bytes", "n_chars", "n_tokens", "width", "steps").mapInArrow(
        fit, f"doc_id {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, fit_tokens bigint")


def count_at(counts: DataFrame, chars: str, out: str = "tokens_at") -> DataFrame:
    """``counts`` with the token count of each row's prefix of ``chars`` code points (a column of
    ``counts``; beyond the end: the whole text, null or below 0: null)."""
    out = free_name(counts, out)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            found = []
            for at, width, steps in zip(*(batch.column(names.index(c)).to_pylist() for c in (chars, "width", "steps"))):
                head = steps[:max(at, 0) * width] if at is not None else b""
                found.append(None if at is None or at < 0 else int(np.frombuffer(head, np.int8 if width == 1 else "<i4").sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, out])

    return counts.mapInArrow(look_up, counts.withColumn(out, F.lit(None).cast("bigint")).schema)
