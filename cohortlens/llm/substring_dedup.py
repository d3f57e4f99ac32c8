"""Substring deduplication: suffix automata of reference shards and matching statistics.

A window is ``WINDOW`` consecutive words. A word is removed when some window that covers it
has the same words as a window that starts earlier (smaller doc_id, or same document and
earlier start); windows are judged on the input.

1. Anchors. Of every window the 6-word gram with the least hash is its anchor (winnowing), so
   equal windows have equal anchors. One in about eight words starts an anchor. An aggregate
   counts them; windows whose anchor occurs once are unique and need no more work.
2. Reference shards. The home of an anchor is the smallest doc_id that holds it. Runs of
   windows with anchors of one home are passages of that shard: a copied passage stays in
   one piece, and equal windows always meet in the same shard.
3. Automata. A task takes a shard's passages in (doc_id, start) order and streams them through
   the shard's suffix automaton over words. The matching statistic (length of the longest
   suffix seen before) tells which windows start earlier; maximal uncovered runs are
   appended to the automaton (whose suffix links also reveal repeats inside a run), so the
   automaton holds each distinct window once, as its first occurrence.
4. Anchors in more than ``HOT`` places (a line found everywhere) would make one shard hot.
   Their windows go another exact way: a map-side combined aggregate finds the first place of
   each 128-bit window hash. All other occurrences are covered, so only these *exceptions* (one
   per distinct window) travel back, to the documents that hold them; occurrences never do.
5. The spans of each document are merged and removed in one pass over the texts.

Automata are not broadcast whole: the reference grows with the corpus, so each shard's
automaton is built and used in the task that its passages are shuffled to. A shard holds
at most HOT occurrences of each anchor of its home document; documents without a doc_id have homes by their text.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null
doc_id sorts before all others; rows repeating a doc_id and text are one document and get
the same result, other texts under the same doc_id are ordered by a hash of the text; an
empty table gives an empty result; only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ngram_hashes, slices, word_hashes

WINDOW = 20
GRAM = 6
HOT = 512
FIRST_HELD = 200_000  # hot windows that a task gathers before it hands them on
FIRST_ID = -(1 << 63)


def plain_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def window_anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for every window the position of its least gram (leftmost)."""
    grams = ngram_hashes(hashes, gram)
    width = window - gram + 1
    if len(grams) < width:
        return grams, np.empty(0, np.int64)
    # least of 1, 2, 4, ... grams, then of ``width``; the right one only if less, so leftmost
    least, at, size = grams, np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    return grams, at


# ---------------------------------------------------------------- the automaton
class SuffixAutomaton:
    """Online suffix automaton of a sequence of words; ``None``-like separators are unique
    objects, so no match crosses them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, word) -> int:
        """Append a word; the length of the longest suffix that occurred before."""
        nxt, link, length = self.next, self.link, self.length
        now, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[now] = clone
        self.last = now
        return length[link[now]]

    def statistics(self, words: list) -> list[int]:
        """For each position the length of the longest suffix that occurs in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            out.append(size)
        return out

    def covered(self, words: list, window: int) -> list[int]:
        """Starts of the windows of a passage that occur before; the others are added."""
        seen = [size >= window for size in self.statistics(words)]
        starts = [end - window + 1 for end in range(window - 1, len(words)) if seen[end]]
        end = window - 1
        while end < len(words):
            if seen[end]:
                end += 1
                continue
            stop = end
            while stop < len(words) and not seen[stop]:
                stop += 1
            self.extend(object())
            for at in range(end - window + 1, stop):
                if self.extend(words[at]) >= window and at >= end:
                    starts.append(at - window + 1)
            end = stop
        return starts


# ---------------------------------------------------------------- Spark stages
def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th (text hash), text: the document key used inside this module."""
    return docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(FIRST_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def anchor_rows(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc, th, pos) of every distinct anchor position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, where, docs, ths = [], [], [], []
            for doc, th, value in zip(*(c.to_pylist() for c in batch.columns)):
                grams, least = window_anchors(word_hashes(plain_words(value)), window, gram)
                at = np.unique(least)
                found.append(grams[at])
                where.append(at)
                docs.append(np.full(len(at), doc, np.int64))
                ths.append(np.full(len(at), th, np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ths)),
                pa.array(np.concatenate(where).astype(np.int32)),
            ], names=["anchor", "doc", "th", "pos"])

    return keyed.mapInArrow(run, "anchor bigint, doc bigint, th bigint, pos int")


def packed_texts(keyed: DataFrame) -> DataFrame:
    """(doc, th, packed): texts compressed before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary()),
            ], names=["doc", "th", "packed"])

    return keyed.mapInArrow(run, "doc bigint, th bigint, packed binary")


def passages(keyed: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """Candidate windows of all documents: passages (``words`` set, with their home); per document
    the ``starts`` of all its windows of hot anchors; and the first occurrence (doc, th, start) of
    each such window's hash (w1, w2) in a task, gathered there in a bounded table."""
    anchors = anchor_rows(keyed, window, gram)
    place = F.struct("doc", F.when(F.col("doc") == FIRST_ID, F.col("th")).alias("th"))  # null ids: a home per text
    known = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_home")).where("n > 1").select(
        "anchor", "n", F.when(F.col("_home.th").isNull(), F.col("_home.doc")).otherwise(F.xxhash64("_home.th")).alias("home"))
    # a set: rows that repeat a document and its text give each anchor once
    met = anchors.join(known, "anchor").groupBy("doc", "th").agg(
        F.collect_set(F.struct("pos", "home", (F.col("n") > hot).alias("hot"))).alias("met"))
    joined = packed_texts(keyed).join(met, ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, first = zstandard.ZstdDecompressor(), {}

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, _CUT_TYPES)], names=_CUT_NAMES)

        for batch in slices(batches, 64):
            out = []
            for doc, th, packed, met_ in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpack.decompress(packed).split()
                out.extend(_cut(doc, th, words, met_, window, gram, first))
            if len(first) > FIRST_HELD:
                out.extend((None, *place, None, *pair, None) for pair, place in first.items())
                first.clear()
            yield rows(out)
        pairs = list(first.items())
        for at in range(0, len(pairs), 50_000):
            yield rows([(None, *place, None, *pair, None) for pair, place in pairs[at:at + 50_000]])

    return joined.select("doc", "th", "packed", "met").mapInArrow(
        run, "home bigint, doc bigint, th bigint, start int, words binary, w1 bigint, w2 bigint, starts array<int>")


_CUT_NAMES = ["home", "doc", "th", "start", "words", "w1", "w2", "starts"]
_CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())]


def _cut(doc: int, th: int, words: list[bytes], met: list[dict], window: int, gram: int, first: dict) -> list[tuple]:
    """A document's passages and its hot starts; ``first`` keeps the least place of each hot window."""
    hashes = word_hashes(words)
    _, least = window_anchors(hashes, window, gram)
    kind = np.zeros(len(words), np.int8)  # of an anchor position: 1 met again, 2 hot
    home = np.zeros(len(words), np.int64)
    for m in met:
        kind[m["pos"]] = 2 if m["hot"] else 1
        home[m["pos"]] = m["home"]
    window_kind, window_home = kind[least], home[least]
    change = np.flatnonzero((window_kind[1:] != window_kind[:-1]) | (window_home[1:] != window_home[:-1])) + 1
    bounds = [0, *change.tolist(), len(least)]
    out = []
    both, starts = None, []
    for a, b in zip(bounds, bounds[1:]):
        if window_kind[a] == 1:
            out.append((int(window_home[a]), doc, th, a, b" ".join(words[a:b + window - 1]), None, None, None))
        elif window_kind[a] == 2:
            if both is None:
                both = [ngram_hashes(h, window).view(np.int64) for h in (hashes, hashes * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x5851F42D4C957F2D))]
            for s, pair in enumerate(zip(both[0][a:b].tolist(), both[1][a:b].tolist()), a):
                place = (doc, th, s)
                if first.setdefault(pair, place) > place:
                    first[pair] = place
            starts.extend(range(a, b))
    if starts:
        out.append((None, doc, th, None, None, None, None, starts))
    return out


def shard_spans(rows: DataFrame, window: int) -> DataFrame:
    """Covered spans (doc, th, start, end) of the passages, one shard's automaton at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, automaton, previous = None, SuffixAutomaton(), None
        for batch in slices(batches, 64):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != home:
                    home, automaton = row[0], SuffixAutomaton()
                if row[:4] == previous:
                    continue  # the same document again
                previous = row[:4]
                for a, b in merged([(s, s + window) for s in automaton.covered(row[4].split(), window)]):
                    out.append((row[1], row[2], row[3] + a, row[3] + b))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, _SPAN_TYPES)], names=["doc", "th", "start", "end"])

    ordered = rows.where("words is not null").select("home", "doc", "th", "start", "words").repartition("home").sortWithinPartitions("home", "doc", "th", "start")
    return ordered.mapInArrow(run, "doc bigint, th bigint, start int, end int")


_SPAN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """(doc, th, spans) of covered windows of hot anchors: all of a document's but those that are
    the first occurrence of their hash."""
    place = F.struct("doc", "th", "start")
    first = rows.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.min(place).alias("_first")).select("_first.*")
    exceptions = first.groupBy("doc", "th").agg(F.collect_list("start").alias("_new"))  # starts of one document
    whole = rows.where("starts IS NOT NULL").select("doc", "th", "starts").join(exceptions, ["doc", "th"], "left")
    later = F.when(F.col("_new").isNull(), F.col("starts")).otherwise(F.array_except("starts", "_new"))
    return whole.select("doc", "th", F.transform(later, lambda s: F.struct(s.alias("start"), (s + window).alias("end"))).alias("spans")).where(F.size("spans") > 0)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans united, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, th, spans): per document the word spans to remove; documents without any are missing."""
    rows = cut_lineage(passages(_keyed(docs, key, text), window, gram, hot))
    cold = shard_spans(rows, window).select("doc", "th", F.array(F.struct("start", "end")).alias("spans"))
    return cold.unionByName(hot_spans(rows, window)).groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row (joined by one blank)."""
    spans = repeated_spans(docs, key, text, window, gram, hot)
    keyed = _keyed(docs, key, text)
    rows = packed_texts(keyed).join(spans, ["doc", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            ids, totals, gone, kept = [], [], [], []
            for doc, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpack.decompress(packed).split()
                left, at = [], 0
                for a, b in merged([(s["start"], s["end"]) for s in found or []]):
                    left.extend(words[at:a])
                    at = b
                left.extend(words[at:])
                ids.append(None if doc == FIRST_ID else doc)
                totals.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.select("doc", "packed", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

