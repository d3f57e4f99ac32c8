"""Ranked lexical search: best-first document intervals bounded by range-maximum queries.

``search`` ranks all documents for each item of a query table by a sum of integer term
impacts (a saturated term frequency, normalised by document length, times the term's
weight). Documents are cut into blocks; in a block every query term has a posting list in
document order with its impacts and a sparse table over them: for each power of two the
position of the greatest impact of the run of that length, so the greatest impact in any
range of documents is two look-ups. An item is answered best-first: an interval of documents
is bounded by the sum of its terms' range maxima, the interval with the greatest bound is
split at the document of the greatest single impact, that document is scored exactly, and
both halves go back to the queue with bounds of their own. When no bound can enter the best
``k`` any more, the block is done; short intervals are scored whole.

Two passes over compact postings (written once, query terms only):

1. documents to (doc_id, length, term numbers, frequencies); counts of documents and terms
   are aggregated per query term, and the term weights follow;
2. blocks of at most ``BLOCK_POSTINGS`` postings are searched. A first, shallow round scores
   the most promising documents of each block; the ``k``-th best over all blocks is a floor
   for the full round, so blocks without a contender end at once.

The driver and the broadcasts hold query terms of one block of items only (at most
``ITEM_BYTES`` of item text; more items are further passes). No posting list, score list or
document set is gathered over blocks: a block gives at most ``k`` rows an item, which a salted
two-round top-k merges.

Defined cases: a null or termless document has no terms (it counts in nothing and is never
returned); a null or termless item, and one that no document matches, has no rows; items with
the same item_id are ranked one by one, as rows of that id; equal scores rank by ascending
doc_id, null doc_ids last, repeated rows side by side; empty tables give an empty result; only the named columns are
read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_k_per_group
from .common import cut_lineage, slices

ITEM_BYTES = 8_000_000
BLOCK_POSTINGS = 1_500_000
BLOCK_DOCS = 30_000
LEAF = 24  # intervals of at most so many documents are scored whole
SHALLOW_SPLITS = 12

# Fixed values of the ranking.
WEIGHT_SCALE = 1000
FREQUENCY_SCALE = 1_000_000_000
FREQUENCY_UNIT = 1000
LENGTH_UNIT = 8
LENGTH_SHARE = 75  # of 100

_TERM_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes((b if b in _TERM_BYTES else 0x20) for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """Terms of letters, digits and non-ASCII characters, A-Z lower-cased (on UTF-8 bytes)."""
    return text.encode().translate(_NORMAL).split() if text else []


def weight(documents: int, with_term: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * with_term + 1)))


def length_factors(lengths: np.ndarray, documents: int, total_terms: int) -> np.ndarray:
    """m of each document, in 64-bit arithmetic where it fits and exact integers beyond."""
    if len(lengths) and LENGTH_SHARE * int(lengths.max()) * documents < 1 << 62:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths.astype(np.int64) * documents // total_terms
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total_terms for n in lengths.tolist()], np.int64)


class Block:
    """Posting lists of one block of documents, in document order, with their sparse tables."""

    def __init__(self, doc_of: np.ndarray, term_of: np.ndarray, frequency: np.ndarray, factor: np.ndarray, weights: np.ndarray):
        order = np.lexsort((doc_of, term_of))
        self.size = len(factor)
        self.doc, term = doc_of[order].astype(np.int64), term_of[order].astype(np.int64)
        tf = frequency[order].astype(np.int64)
        self.impact = weights[term] * (FREQUENCY_SCALE * tf // (FREQUENCY_UNIT * tf + LENGTH_UNIT * factor[self.doc]))
        self.place = term * self.size + self.doc  # ascending: finds a document's place in any list
        present, first = np.unique(term, return_index=True)
        self.list_of = dict(zip(present.tolist(), range(len(present))))
        self.first = np.append(first, len(term))
        self.base = present * self.size
        longest = int(np.diff(self.first).max(initial=1))
        # tables[j][i]: place of the greatest impact among i .. i + 2**j - 1 (the first of equals)
        self.tables = [np.arange(len(term), dtype=np.int32)]
        while (step := 1 << (len(self.tables) - 1)) * 2 <= longest:
            below = self.tables[-1]
            left, right = below[:-step], below[step:]
            table = below.copy()  # runs past a list's end are never asked for
            table[:-step] = np.where(self.impact[right] > self.impact[left], right, left)
            self.tables.append(table)
        self.flat = np.concatenate(self.tables)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts in the non-empty ranges [low, high)."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        offset = level.astype(np.int64) * len(self.doc)
        left = self.flat[offset + low]
        right = self.flat[offset + high - (np.int64(1) << level.astype(np.int64))]
        return np.where(self.impact[right] > self.impact[left], right, left)

    def best(self, query: dict[int, int], k: int, floor: int, splits: int | None = None) -> list[tuple[int, int]]:
        """(score, document) of the best documents for a query (term number -> repeats): the
        documents scoring at least ``floor`` among the best ``k`` of the block, ties to lower
        documents. With ``splits`` the search ends after so many intervals (some good documents)."""
        lists = np.array([self.list_of[t] for t in query if t in self.list_of], np.int64)
        if not len(lists):
            return []
        times = np.array([query[t] for t in query if t in self.list_of], np.int64)
        base = self.base[lists]
        found: list[tuple[int, int]] = []  # heap of (score, -document): the worst on top

        def offer(score: int, document: int) -> None:
            if score < max(floor, 1):
                return
            if len(found) < k:
                heapq.heappush(found, (score, -document))
            elif (score, -document) > found[0]:
                heapq.heapreplace(found, (score, -document))

        queue: list[tuple] = []

        def push(start: int, end: int, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> None:
            some = high > low
            if not some.any():
                return
            low, high, which = low[some], high[some], which[some]
            if end - start <= LEAF:
                self._score_all(low, high, times[which], offer)
                return
            at = self.maxima(low, high)
            parts = self.impact[at] * times[which]
            bound = int(parts.sum())
            if bound >= max(floor, 1) and (len(found) < k or (bound, -start) > found[0]):
                heapq.heappush(queue, (-bound, start, end, low, high, which, int(self.doc[at[int(parts.argmax())]])))

        push(0, self.size, self.first[lists], self.first[lists + 1], np.arange(len(lists)))
        done = 0
        while queue and (splits is None or done < splits):
            bound, start, end, low, high, which, split = heapq.heappop(queue)
            if len(found) == k and (-bound, -start) <= found[0]:
                if -bound < found[0][0]:
                    break
                continue
            done += 1
            middle = np.searchsorted(self.place, base[which] + split)
            inside = middle < high
            hit = inside.copy()
            hit[inside] = self.place[middle[inside]] == base[which[inside]] + split
            offer(int((self.impact[middle[hit]] * times[which[hit]]).sum()), split)
            push(start, split, low, middle, which)
            push(split + 1, end, middle + hit, high, which)
        return [(score, -document) for score, document in sorted(found, reverse=True)]

    def _score_all(self, low: np.ndarray, high: np.ndarray, times: np.ndarray, offer) -> None:
        """Exact scores of all documents with a posting in the ranges."""
        sizes = high - low
        places = np.repeat(high - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))
        documents = self.doc[places]
        least = int(documents.min())
        scores = np.zeros(int(documents.max()) - least + 1, np.int64)
        np.add.at(scores, documents - least, self.impact[places] * np.repeat(times, sizes))
        for document in np.flatnonzero(scores).tolist():
            offer(int(scores[document]), least + document)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """doc_id, n (terms), term numbers and frequencies of the vocabulary's terms, for documents with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in slices(batches):
            keep, lengths, terms, frequencies = [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                words = terms_of(value)
                if words:
                    known = Counter(map(number, words))
                    known.pop(None, None)
                    keep.append(row)
                    lengths.append(len(words))
                    terms.append(np.fromiter(known.keys(), "<i4", len(known)).tobytes())
                    frequencies.append(np.fromiter(known.values(), "<i4", len(known)).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(frequencies, pa.binary()),
            ], names=["doc_id", "n", "terms", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(count, f"doc_id {kind}, n bigint, terms binary, tf binary")


def statistics(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and documents per vocabulary term (``size`` numbers)."""
    totals = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in slices(batches):
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["term", "n"])

    with_term = np.zeros(size, np.int64)
    for row in table.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        with_term[row["term"]] = row["n"]
    return totals["n"], totals["terms"] or 0, with_term


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, document, term, frequency) of consecutive blocks of the task's rows, by
    ascending doc_id inside a block."""
    ids, lengths, terms, frequencies, held = [], [], [], [], 0

    def flush():
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        sizes = np.array([len(terms[i]) // 4 for i in order], np.int64)
        return (
            [ids[i] for i in order], np.array([lengths[i] for i in order], np.int64), np.repeat(np.arange(len(order)), sizes),
            np.frombuffer(b"".join(terms[i] for i in order), "<i4"), np.frombuffer(b"".join(frequencies[i] for i in order), "<i4"),
        )

    for batch in slices(batches):
        for doc, n, term, tf in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if term:
                ids.append(doc)
                lengths.append(n)
                terms.append(term)
                frequencies.append(tf)
                held += len(term) // 4
            if held >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                yield flush()
                ids, lengths, terms, frequencies, held = [], [], [], [], 0
    if ids:
        yield flush()


def _round(table: DataFrame, shared, k: int, splits: int | None) -> DataFrame:
    """item (its number), doc_id and score of each block's best documents."""
    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, total, floors = shared.value
        for ids, lengths, doc_of, term_of, frequency in _blocks(batches):
            block = Block(doc_of, term_of, frequency, length_factors(lengths, documents, total), weights)
            rows = [(i, ids[d], s) for i, query in enumerate(queries) for s, d in block.best(query, k, floors[i], splits)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind_arrow), pa.array([r[2] for r in rows], pa.int64()),
            ], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(table.schema["doc_id"].dataType)
    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(search_blocks, f"item int, doc_id {kind}, score bigint")


def _merge(rows: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_k_per_group(rows.withColumn("_row", F.monotonically_increasing_id()), ["item"], [*order, F.col("_row")], k, F.col("_row")).drop("_row")


def item_blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) of all items with text, at most about ``block_bytes`` of text at a time."""
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [(r[0], r[1]) for r in part.collect()]


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    out = None
    for block in item_blocks(items, item, item_text, item_bytes):
        vocabulary: dict[bytes, int] = {}
        queries = []
        for _, value in block:
            queries.append({vocabulary.setdefault(t, len(vocabulary)): n for t, n in Counter(terms_of(value)).items()})
        table = cut_lineage(postings(docs, vocabulary, key, text))
        documents, total, with_term = statistics(table, len(vocabulary))
        weights = np.array([weight(documents, n) for n in with_term.tolist()], np.int64)

        def shared(floors: list[int]):
            return spark.sparkContext.broadcast((queries, weights, documents, total, floors))

        shallow = _merge(_round(table, shared([1] * len(queries)), k, SHALLOW_SPLITS), k)
        floors = [1] * len(queries)
        for row in shallow.where(F.col("rank") == k).collect():  # at most one row an item of this block
            floors[row["item"]] = row["score"]
        ranked = _merge(_round(table, shared(floors), k, None), k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item int, item_id {item_kind}")
        part = cut_lineage(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
