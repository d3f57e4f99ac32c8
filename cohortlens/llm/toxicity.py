"""Toxicity score: a factorisation machine over hashed terms.

A text's terms are its distinct words (letters and digits, lower-cased) and their
prefixes of 4 to 7 bytes, hashed to 2**26 places. The model is

    logit = b + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)

over the terms present, so pairs of terms (an insult next to a mention of a group) carry
weight of their own that a linear model cannot express.

The model is fitted on a bounded sample: about ``FIT_ROWS`` labelled training documents,
drawn by a hash of doc_id (all of them while there are fewer). Every hashed term seen in at
least ``MIN_DOCS`` documents of that sample enters the machine: a term may matter in pairs
only, so none is judged by its own association with the labels. The parameters (terms of the
sample * (FACTORS + 1) numbers) come back from the one task that fits them and are broadcast and all documents are scored in one map-only
pass. Labels, language, source and doc_id are no inputs of a score.

Defined cases: a null, empty or unknown-word text gets the score of the bias alone; rows
with a null label or null doc_id teach nothing; several labels of one doc_id count as
toxic if any is; without training rows every score is 0, and with one class only it is
that class; repeated documents get equal scores; extra columns pass through ``score``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, slices

FIT_ROWS = 20_000
MIN_DOCS = 4
PLACES = 1 << 26
FACTORS = 8
RATE, L2 = 0.1, 1e-5
EVIDENCE = 20.0  # chi-squared of a term's own counts from which its linear weight moves freely
FACTOR_RATE, FACTOR_L2 = 0.02, 5e-3
BATCH_ROWS = 2500
STEP_TERMS = 1 << 14  # parameters of so many terms are moved at once
THRESHOLD = 0.3
MEMO_WORDS = 200_000

_WORD_BYTES = bytes((b if b >= 0x80 or chr(b).isalnum() else 0x20) for b in range(256))
_PREFIXES = (4, 5, 6, 7)


def text_words(text: str | None) -> set[bytes]:
    return set(text.lower().encode().translate(_WORD_BYTES).split()) if text else set()


def word_terms(word: bytes) -> list[int]:
    """Hashed places of a word and of its proper prefixes."""
    place = xxhash.xxh3_64_intdigest
    return [place(word) % PLACES, *(place(word[:n], 1) % PLACES for n in _PREFIXES if len(word) > n)]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@dataclass
class FactorisationMachine:
    """Parameters over the chosen terms; ``places`` is sorted."""

    places: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, indices: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Logit per row of the sparse 0/1 matrix (rows, indices), and the factor sums."""
        sums = np.stack([np.bincount(rows, f[indices], n_rows) for f in self.factors], 1) if len(indices) else np.zeros((n_rows, len(self.factors)))
        squares = (self.factors ** 2).sum(0)
        linear = np.bincount(rows, (self.weights - squares / 2)[indices], n_rows) if len(indices) else np.zeros(n_rows)
        return self.bias + linear + (sums ** 2).sum(1) / 2, sums


@dataclass
class _Batch:
    """Rows of the design matrix, ordered by row and by term."""

    labels: np.ndarray
    filled: np.ndarray      # rows that have terms
    by_row: np.ndarray      # terms in order of rows
    row_starts: np.ndarray
    terms: np.ndarray       # distinct terms
    by_term: np.ndarray     # rows in order of terms
    term_starts: np.ndarray

    @classmethod
    def of(cls, indices: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> _Batch:
        filled = np.flatnonzero(lengths)
        row_starts = (np.cumsum(lengths) - lengths)[filled]
        order = np.argsort(indices, kind="stable")
        by_term = indices[order]
        term_starts = np.flatnonzero(np.append(True, by_term[1:] != by_term[:-1])[:len(by_term)])
        terms = by_term[term_starts]
        rows = np.repeat(np.arange(len(lengths), dtype=np.min_scalar_type(len(lengths))), lengths)
        return cls(labels, filled, indices, row_starts, terms, rows[order], term_starts)


def _batches(picked: list, labels: np.ndarray, rng: np.random.Generator) -> list[_Batch]:
    """The rows dealt at random into batches of about ``BATCH_ROWS``; besides the batches only one of them is held."""
    n = len(labels)
    count = max(1, round(n / BATCH_ROWS))
    batch_of = rng.permutation(n) % count
    out = []
    for b in range(count):
        own = np.flatnonzero(batch_of == b)
        rows = [picked[i] for i in own.tolist()]
        lengths = np.array([len(r) // 4 for r in rows], np.int64)
        out.append(_Batch.of(np.frombuffer(b"".join(rows), "<i4"), lengths, labels[own]))
    return out


def _sums(table: np.ndarray, picks: np.ndarray, starts: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Sums of the picked rows of ``table`` between the starts, some segments at a time."""
    ends, out = np.append(starts[1:], len(picks)), np.empty((len(starts), table.shape[1]), table.dtype)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        out[at:to] = np.add.reduceat(table[picks[starts[at]:ends[to - 1]]], starts[at:to] - starts[at], axis=0)
        at = to
    return out


def _chi2(batches: list[_Batch], m: int) -> np.ndarray:
    """Chi-squared of each term's 2x2 counts."""
    n, p = sum(len(b.labels) for b in batches), sum(b.labels.sum() for b in batches)
    seen, toxic = np.zeros(m), np.zeros(m)
    for b in batches:
        seen[b.terms] += np.diff(b.term_starts, append=len(b.by_term))
        toxic[b.terms] += np.add.reduceat(b.labels[b.by_term], b.term_starts)
    return (toxic * n - seen * p) ** 2 * n / np.maximum(seen * (n - seen) * p * (n - p), 1.0)


def fit_machine(places: np.ndarray, picked: list, labels: np.ndarray, steps: int = 250) -> FactorisationMachine:
    """Adam on the logistic loss, over batches in turn; deterministic. ``picked`` holds each row's
    terms as bytes (32-bit integers); it is emptied once dealt. Linear
    weights move faster than factors, so pairs explain what single terms do not. A term's linear
    weight is scaled by its own evidence, else many rare terms would fit noise; its factors are
    not. Factors move slower the more terms a row has."""
    n, m = len(labels), len(places)
    share = labels.mean() if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        return FactorisationMachine(places, 40.0 if share else -800.0, np.zeros(m), np.zeros((FACTORS, m)))
    rng = np.random.default_rng(7)
    batches = _batches(picked, labels, rng)
    picked.clear()
    theta = np.zeros((m + 1, FACTORS + 1), np.float32)  # the last row is the bias; the first column has the weights
    theta[:m, 1:] = rng.normal(0, 0.02, (m, FACTORS))
    theta[m, 0] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    scale = np.append(np.minimum(1.0, (_chi2(batches, m) / EVIDENCE) ** 2), 1.0).astype(np.float32)
    rate = np.array([RATE] + [FACTOR_RATE / max(1.0, (sum(len(b.by_row) for b in batches) / n) ** 0.5)] * FACTORS, np.float32)
    penalty = np.array([L2] + [FACTOR_L2] * FACTORS, np.float32)
    for t in range(1, steps + 1):
        batch = batches[t % len(batches)]
        size = len(batch.labels)
        table = theta[:m].copy()
        table[:, 0] *= scale[:m]
        table[:, 0] -= (table[:, 1:] ** 2).sum(1) / 2
        sums = np.zeros((size, FACTORS + 1), np.float32)
        sums[batch.filled] = _sums(table, batch.by_row, batch.row_starts)
        logits = theta[m, 0] + sums[:, 0] + (sums[:, 1:] ** 2).sum(1) / 2
        error = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - batch.labels
        sums[:, 0] = 1
        by_term = _sums((sums * error[:, None]).astype(np.float32), batch.by_term, batch.term_starts)
        by_term[:, 1:] -= theta[batch.terms, 1:] * by_term[:, :1]
        by_term[:, 0] *= scale[batch.terms]
        grad = penalty * theta
        grad[m] = 0
        grad[batch.terms] += by_term / np.float32(size)
        grad[m, 0] = error.mean()
        for at in range(0, m + 1, STEP_TERMS):
            f, s, g = (x[at:at + STEP_TERMS] for x in (first, second, grad))
            f *= 0.9
            f += 0.1 * g
            s *= 0.999
            s += 0.001 * g ** 2
            theta[at:at + STEP_TERMS] -= rate * (f / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return FactorisationMachine(places, float(theta[m, 0]), theta[:m, 0] * scale[:m], theta[:m, 1:].T.copy())


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, fit_rows: int) -> DataFrame:
    """label and hashed terms (packed) of about ``fit_rows`` labelled documents that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_label_id")).agg(F.max("toxic").alias("_label"))
    total = known.count()
    if total > fit_rows:
        part = int(fit_rows / total * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("_label_id", F.lit(11)), F.lit(1 << 30)) < part)
    texts = docs.select(F.col(key).alias("_label_id"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(known), "_label_id").select("_label", "_text")  # about fit_rows ids at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [np.unique(np.fromiter((p for w in text_words(t) for p in word_terms(w)), np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(packed, pa.binary())], names=["label", "terms"])

    return rows.mapInArrow(extract, "label int, terms binary")


def choose_terms(sample: DataFrame) -> np.ndarray:
    """Places of the terms seen in at least ``MIN_DOCS`` documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, n = np.unique(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(n)], names=["place", "n"])

    per = sample.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    return np.sort(per.where(F.col("n") >= MIN_DOCS).select("place").toArrow()["place"].to_numpy())


def ordered_rows(batches: Iterator[pa.RecordBatch]) -> tuple[list, np.ndarray]:
    """Each row's terms and its label (0 or 1), in order of both; the terms stay in Arrow's buffers, no copy is made."""
    held = list(batches)
    rows = pa.table({"label": pa.chunked_array([b.column(0) for b in held], pa.int32()), "picked": pa.chunked_array([b.column(1) for b in held], pa.binary())})
    order = pc.sort_indices(rows, [("label", "ascending"), ("picked", "ascending")]).to_numpy()
    labels, picked = rows["label"].to_numpy()[order], rows["picked"]
    return [picked[i].as_buffer() for i in order.tolist()], (labels > 0).astype(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fit on the bounded sample, in a task of its own (``fit_rows`` bounds what it holds); only the
    parameters reach the driver."""
    sample = cut_lineage(training_sample(docs, labels, key, text, fit_rows))
    places = choose_terms(sample)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            picked = []
            for packed in batch.column(1).to_pylist():
                own = np.frombuffer(packed, np.uint32).astype(np.int64)
                at = np.searchsorted(known, own)
                at = at[known[np.minimum(at, len(known) - 1)] == own] if len(known) else at[:0]
                picked.append(at.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.binary())], names=["label", "picked"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = fit_machine(shared.value, *ordered_rows(batches))
        yield pa.RecordBatch.from_arrays([
            pa.array([machine.bias]), pa.array([machine.weights.astype("<f8").tobytes()], pa.binary()), pa.array([machine.factors.astype("<f8").tobytes()], pa.binary()),
        ], names=["bias", "weights", "factors"])

    designed = sample.mapInArrow(design, "label int, picked binary")
    row = designed.repartition(1).mapInArrow(learn, "bias double, weights binary, factors binary").first()
    factors = np.frombuffer(row["factors"], "<f8").reshape(FACTORS, len(places))
    return FactorisationMachine(places, row["bias"], np.frombuffer(row["weights"], "<f8"), factors)


def _scorer(machine: FactorisationMachine):
    """texts -> scores, with a bounded memo of each word's chosen terms."""
    memo: dict[bytes, tuple] = {}
    lookup = {int(p): i for i, p in enumerate(machine.places)}

    def scores(texts: list) -> np.ndarray:
        indices, counts = [], []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for text in texts:
            active: set = set()
            for word in text_words(text):
                hit = memo.get(word)
                if hit is None:
                    hit = memo[word] = tuple(lookup[p] for p in word_terms(word) if p in lookup)
                if hit:
                    active.update(hit)
            indices.extend(sorted(active))
            counts.append(len(active))
        rows = np.repeat(np.arange(len(texts)), counts)
        logits, _ = machine.logits(np.array(indices, np.int64), rows, len(texts))
        return np.where(logits < -700, 0.0, 1 / (1 + np.exp(-np.clip(logits, -700, 700))))

    return scores


def score(docs: DataFrame, machine: FactorisationMachine, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the toxicity score appended (in place of a column of that name)."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast((machine.places, machine.bias, machine.weights, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(FactorisationMachine(*shared.value))
        for batch in slices(batches):
            values = scores(batch.column(batch.schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(column)).schema)


def drop_toxic(docs: DataFrame, machine: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their own columns."""
    name = free_name(docs, "_toxicity")
    return score(docs, machine, text, name).where(F.col(name) < threshold).drop(name)
