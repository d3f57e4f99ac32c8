"""Benchmark decontamination by word n-grams.

The test items' normalised n-grams (13 words; an item with fewer words is one gram of
its length) are hashed into a sorted table that is broadcast to the scanning tasks. A
task hashes every window of a document's words by each gram length, looks the hashes up
and verifies each hit word by word. Covered words are marked; a document is contaminated
when at least 5 % of its words are.

The broadcast has a size bound: items are taken in blocks of about ``block_bytes`` of text at
most, and the index is flat arrays: a word and the gram that begins with it take 20 bytes beside the
text itself, so at most 11 bytes a byte of text (words of one letter). One block is a single map-only pass; more blocks are further map-only passes, each
adding its spans to the row, so a benchmark of any size works and no document is shuffled.

Defined cases: a null or wordless document has no words and is clean; a null or wordless
item matches nothing, nor does an item with a null item_id, whatever its text; items with
equal text all count; repeated documents are judged one by one; an empty benchmark leaves every
document clean. Extra columns of ``docs`` are carried by ``scan`` untouched.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, free_name, ngram_hashes, slices, word_hashes

WORDS_PER_GRAM = 13
BLOCK_BYTES = 16_000_000
SHARE = 20  # contaminated when SHARE * hit words >= words

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes((b if b in _KEEP else 0x20) for b in range(256)).lower()


def benchmark_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased (on UTF-8 bytes:
    every byte of a non-ASCII character is above 0x7F, so characters stay whole)."""
    return text.encode().translate(_NORMAL).split() if text else []


@dataclass(frozen=True)
class GramIndex:
    """Grams of one block of items in flat arrays. ``blob`` holds the items' words, one blank apart;
    word ``w`` begins at byte ``starts[w]``. Per gram length, ``grams`` has the sorted hashes and
    beside each the number of its item and its first word."""

    ids: list
    blob: bytes
    starts: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def words_at(self, first: int, size: int) -> bytes:
        return self.blob[self.starts[first]:self.starts[first + size] - 1]


def gram_index(items: list[tuple], n: int = WORDS_PER_GRAM) -> GramIndex:
    """Index of (item_id, text) rows. A gram that an item repeats is held once for it."""
    ids, blobs, lengths, found, first = [], [], [], {}, 0
    for item_id, text in items:
        words = benchmark_words(text)
        if not words:
            continue
        size = min(n, len(words))
        codes = ngram_hashes(word_hashes(words), size)
        found.setdefault(size, []).append((codes, np.full(len(codes), len(ids), np.uint32), np.arange(first, first + len(codes), dtype=np.uint32)))
        ids.append(item_id)
        blobs.append(b" ".join(words))
        lengths.append(np.fromiter(map(len, words), np.uint32, len(words)))
        first += len(words)
    starts = np.zeros(first + 1, np.uint32)
    if first:
        np.cumsum(np.concatenate(lengths) + np.uint32(1), out=starts[1:])
    index = GramIndex(ids, b" ".join(blobs), starts, {})
    for size in list(found):
        codes, item, at = (np.concatenate(c) for c in zip(*found.pop(size)))
        order = np.lexsort((item, codes))
        codes, item, at = codes[order], item[order], at[order]
        keep, last = np.ones(len(codes), bool), -1
        for i in (np.flatnonzero((codes[1:] == codes[:-1]) & (item[1:] == item[:-1])) + 1).tolist():
            last = last if last >= 0 and codes[last] == codes[i] and item[last] == item[i] else i - 1
            keep[i] = index.words_at(at[last], size) != index.words_at(at[i], size)
        index.grams[size] = codes[keep], item[keep], at[keep]
    return index


def find_spans(index: GramIndex, words: list[bytes]) -> list[tuple[int, int, list]]:
    """Verified occurrences in a document as (first word, end, items)."""
    out = []
    hashes = word_hashes(words)
    for size, (codes, item, first) in index.grams.items():
        windows = ngram_hashes(hashes, size)
        if not len(windows):
            continue
        low = np.searchsorted(codes, windows)
        low[low == len(codes)] = 0
        hits, known = np.flatnonzero(codes[low] == windows), {}
        high = np.searchsorted(codes, windows[hits], "right")
        for start, a, b in zip(hits.tolist(), low[hits].tolist(), high.tolist()):
            gram = b" ".join(words[start:start + size])
            if gram not in known:
                known[gram] = [index.ids[i] for i, w in zip(item[a:b].tolist(), first[a:b].tolist()) if index.words_at(w, size) == gram]
            if known[gram]:
                out.append((start, start + size, known[gram]))
    return out


ADDED = ("_n_words", "_starts", "_ends", "_items")


def _pass(index, text: str, added: tuple[str, ...]):
    """Task function: append this block's spans and items to the row's lists."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = index.value
        for batch in slices(batches):
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            n_words, starts, ends, items = [], [], [], []
            old = [batch.column(names.index(c)).to_pylist() for c in added[1:]]
            for row, value in enumerate(texts):
                words = benchmark_words(value)
                spans = find_spans(grams, words) if words else []
                n_words.append(len(words))
                starts.append((old[0][row] or []) + [s for s, _, _ in spans])
                ends.append((old[1][row] or []) + [e for _, e, _ in spans])
                items.append(sorted(set(old[2][row] or []).union(*(i for _, _, i in spans)) if spans else old[2][row] or [], key=str))
            columns = {c: batch.column(i) for i, c in enumerate(names)}
            columns |= dict(zip(added, (
                pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                pa.array(items, batch.schema.field(added[3]).type),
            )))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return scan


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` of text at most; one block is in the driver
    at a time. A block is a range of a hash of the row, sized from the table's total."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull() & F.col(item).isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r[0], r[1]) for r in part.collect()]


def _scan(
    docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, finish: Callable, schema: T.StructType | None = None,
    n: int = WORDS_PER_GRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` after every block's pass. ``finish`` takes the last pass's batches in the same task (a map of its
    own would start a second Python worker for each running task) and the names of the four added columns."""
    added = tuple(free_name(docs, c) for c in ADDED)
    item_type = benchmark.schema[item].dataType
    out = docs.select(
        "*", F.lit(0).cast("bigint").alias(added[0]), F.lit(None).cast("array<bigint>").alias(added[1]),
        F.lit(None).cast("array<bigint>").alias(added[2]), F.lit(None).cast(T.ArrayType(item_type)).alias(added[3]),
    )
    context, step = docs.sparkSession.sparkContext, None
    for items in item_blocks(benchmark, item, item_text, block_bytes):
        if step:
            out = cut_lineage(out.mapInArrow(step, out.schema))  # else every block's table would be in one task's memory
        step = _pass(context.broadcast(gram_index(items, n)), text, added)
    return out.mapInArrow(lambda batches: finish(step(batches), added), schema or out.schema)


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = WORDS_PER_GRAM, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``_n_words`` and the verified spans ``_starts``, ``_ends`` and ``_items`` as
    its last four columns (underscores are appended to names that ``docs`` has already)."""
    return _scan(docs, benchmark, text, item, item_text, lambda batches, added: batches, None, n, block_bytes)


def _cover(n_words: int, starts, ends) -> np.ndarray:
    hit = np.zeros(n_words + 1, np.int64)
    if len(starts):
        np.add.at(hit, np.asarray(starts), 1)
        np.add.at(hit, np.asarray(ends), -1)
    return np.cumsum(hit)[:n_words] > 0


def verdicts(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            _, n_words, starts, ends, items = (batch.column(i).to_pylist() for i in range(5))
            hits = [int(_cover(n, s or [], e or []).sum()) if s else 0 for n, s, e in zip(n_words, starts, ends)]
            ids = [sorted(map(str, i or [])) for i in items]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], pa.string()),
                pa.array([h > 0 and SHARE * h >= n for h, n in zip(hits, n_words)], pa.bool_()),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = scanned.schema[key].dataType.simpleString()
    narrow = scanned.select(F.col(key).alias("doc_id"), *scanned.columns[-4:])
    return narrow.mapInArrow(judge, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are clean, with their own columns."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch], added: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keep = [
                not (s and SHARE * int(_cover(n, s, e).sum()) >= n)
                for n, s, e in zip(*(got[c].to_pylist() for c in added[:3]))
            ]
            yield pa.RecordBatch.from_arrays([got[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, benchmark, text, item, item_text, clean, docs.schema)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with hit words removed from ``text``; other characters, also those between
    words, stay. Rows without hits are unchanged."""
    names = docs.columns

    def remove(value: str, n_words: int, starts, ends) -> str:
        hit, raw = _cover(n_words, starts, ends), value.encode()
        norm, kept, at, end = raw.translate(_NORMAL), [], 0, 0
        for word, gone in zip(norm.split(), hit):
            begin = norm.index(word, end)
            end = begin + len(word)
            if gone:
                kept.append(raw[at:begin])
                at = end
        return b"".join([*kept, raw[at:]]).decode()

    def cut(batches: Iterator[pa.RecordBatch], added: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            parts = zip(*(got[c].to_pylist() for c in (text, *added[:3])))
            got[text] = pa.array([remove(t, n, s, e) if s else t for t, n, s, e in parts], pa.string())
            yield pa.RecordBatch.from_arrays([got[c] for c in names], names=names)

    return _scan(docs, benchmark, text, item, item_text, cut, docs.schema)
