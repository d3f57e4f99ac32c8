"""Near-duplicate detection with SetSketch registers.

A text's shingle set is sketched by 256 registers. Register ``i`` is the exponentially
spaced, truncated minimum of an exponential hash over the set,
``K_i = clip(floor(1 - log_b(min_d h_i(d))), 0, 255)``; since the transform is monotone it
is applied to the smallest hash only. Registers of a union are register-wise maxima
(``merge``), and two sets agree in a register with a probability that grows with their
similarity.

1. Sketch: one map-only pass gives per document the set size, a 128-bit digest of the set
   and the registers. Documents with equal sets form one class.
2. Bands: 6 registers make a band; classes sharing a band of 42 meet in a bucket. A pair of
   similarity 0.8 shares no band with a probability of about 3e-6.
3. Estimate: inside a bucket the joint likelihood of (registers above, below, equal) and the
   two set sizes is judged at the wanted similarity less ``MARGIN`` (over four standard errors): its
   derivative there tells whether the maximum-likelihood similarity is higher. Of the pairs that pass, only a spanning forest
   per bucket leaves the task; the forests' components ("candidate groups") hold every link.
4. Verify: the full shingle sets of each candidate group's classes are compared exactly, in
   integers. Again only a spanning forest of the links leaves a task.
5. The links' components are the near-duplicate groups.

No task holds an unbounded group: a bucket or candidate group larger than one block is cut
into blocks by a hash of the class, and every pair of blocks is a unit of its own, so all
pairs are judged without being emitted and the work spreads over tasks. Blocks have at most
about ``BLOCK_ROWS`` classes and ``BLOCK_BYTES`` of sets.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a
text with fewer words than a shingle is one shingle; a null doc_id keeps its row with the
component of its set's class (null where no id is known); repeated rows are one class; an
empty table gives an empty result; only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut_lineage, ngram_hashes, slices, word_hashes
from .components import connected_components

REGISTERS, BAND = 256, 6
BANDS = REGISTERS // BAND
BASE = 1.2
MARGIN = 0.12
BLOCK_ROWS = 1024
BLOCK_BYTES = 8_000_000
STEP = 1024  # set elements hashed at once

_RNG = np.random.default_rng(20240601)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


# ---------------------------------------------------------------- sets and registers
def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle of its length."""
    parts = ascii_words(text)
    if not parts:
        return np.empty(0, np.uint64)
    size = min(words, len(parts))
    codes = np.sort(ngram_hashes(word_hashes(parts), size)) ^ np.uint64(size * 0x9E3779B1)
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


def registers(codes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint8) of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), STEP):
        np.minimum(low, ((codes[at:at + STEP, None] ^ _MASKS) * _MULTIPLIERS).min(0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64)
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def similarity_above(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, level: float) -> np.ndarray:
    """Whether the maximum-likelihood Jaccard similarity is at least ``level``.

    With u, v the sets' shares of n_a + n_b, P(K_a > K_b) = p(u - vJ), P(K_a < K_b) =
    p(v - uJ), p(x) = -log_b(1 - x(b-1)/b); the log-likelihood is concave in J, so the sign
    of its derivative at ``level`` decides."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)
    x, y = np.maximum(u - v * level, 1e-9), np.maximum(v - u * level, 1e-9)
    p, q = -np.log1p(-x * scale) / log_b, -np.log1p(-y * scale) / log_b
    dp, dq = scale / ((1 - x * scale) * log_b), scale / ((1 - y * scale) * log_b)
    slope = -above * v * dp / p - below * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9)
    return slope >= 0


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Joint maximum-likelihood similarity of two sketches (bisection on the slope)."""
    counts = [np.array([float(c)]) for c in ((a == b).sum(), (a > b).sum(), (a < b).sum())]
    low, high = 0.0, min(n_a, n_b) / max(n_a, n_b)
    for _ in range(40):
        mid = (low + high) / 2
        if similarity_above(*counts, np.array([n_a]), np.array([n_b]), mid)[0]:
            low = mid
        else:
            high = mid
    return low


class Forest:
    """Trees over positions as a label array; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        return others[self.label[others] != self.label[x]]

    def join(self, x: int, y: int) -> None:
        a, b = self.label[x], self.label[y]
        if a != b:
            self.label[self.label == b] = a
            self.links.append((x, y))


# ---------------------------------------------------------------- units: blocks and pairs of blocks
def with_units(members: DataFrame, blocks: str) -> DataFrame:
    """Copy every row of a group of ``blocks`` blocks to the units (pairs of blocks) that
    need it: ``unit`` names the pair, ``side`` tells the row's block in it."""
    own = F.pmod(F.xxhash64("cls"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    rows = members.withColumn("_own", own).withColumn("_other", other)
    return rows.withColumn("unit", F.least("_own", "_other").cast("bigint") * F.col(blocks) + F.greatest("_own", "_other")).withColumn(
        "side", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other")


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (group, unit) at a time, from batches sorted by the first two columns."""
    now, rows = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now:
                if len(rows) > 1:
                    yield rows
                now, rows = row[:2], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def candidate_links(rows: list[tuple], level: float, percent: int) -> list[tuple]:
    """Spanning forest of a unit's pairs whose estimate passes. Row: group, unit, side, class,
    set size, registers."""
    side = np.array([r[2] for r in rows])
    size = np.array([r[4] for r in rows], np.float64)
    sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, REGISTERS)
    forest = Forest(len(rows))
    two = side.any() and not side.all()
    for x in range(len(rows) - 1):
        if two and side[x]:
            continue
        others = np.flatnonzero(side == 1) if two else np.arange(x + 1, len(rows))
        others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
        others = forest.apart(x, others)
        if not len(others):
            continue
        theirs = sketch[others]
        equal, above = (theirs == sketch[x]).sum(1), (theirs < sketch[x]).sum(1)
        passed = similarity_above(equal, above, REGISTERS - equal - above, size[x], size[others], level)
        for y in others[passed].tolist():
            forest.join(x, y)
    return [(rows[a][3], rows[b][3]) for a, b in forest.links]


def verified_links(rows: list[tuple], level: float, percent: int) -> list[tuple]:
    """Spanning forest of a unit's true links, by exact intersections of the full sets. Row:
    group, unit, side, class, registers, set."""
    side = np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, REGISTERS)
    forest = Forest(len(rows))
    two = side.any() and not side.all()
    for x in range(len(rows) - 1):
        if two and side[x]:
            continue
        others = np.flatnonzero(side == 1) if two else np.arange(x + 1, len(rows))
        others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
        others = forest.apart(x, others)
        if not len(others):
            continue
        theirs = sketch[others]
        equal, above = (theirs == sketch[x]).sum(1), (theirs < sketch[x]).sum(1)
        others = others[similarity_above(equal, above, REGISTERS - equal - above, size[x].astype(float), size[others].astype(float), level)]
        for at in range(0, len(others), 64):
            part = others[at:at + 64]
            ends = np.cumsum(size[part])
            pool = np.concatenate([sets[y] for y in part])
            place = np.searchsorted(sets[x], pool)
            place[place == size[x]] = 0
            common = np.add.reduceat((sets[x][place] == pool).astype(np.int64), ends - size[part])
            for y, c in zip(part.tolist(), common.tolist()):
                if 100 * c >= percent * (size[x] + size[y] - c):
                    forest.join(x, y)
    return [(rows[a][3], rows[b][3]) for a, b in forest.links]


def _link_task(find, level: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in unit_rows(batches):
            links = find(rows, level, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    return run


# ---------------------------------------------------------------- Spark stages
def sketch_documents(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest (two longs) and registers (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, high, low, sketches = [], [], [], []
            for value in batch.column(1).to_pylist():
                codes = shingle_set(value, words)
                digest = xxhash.xxh3_128_intdigest(codes.tobytes()) if len(codes) else None
                sizes.append(len(codes))
                high.append(None if digest is None else (digest >> 64) - (1 << 63))
                low.append(None if digest is None else (digest & (1 << 64) - 1) - (1 << 63))
                sketches.append(registers(codes).tobytes() if len(codes) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.binary()),
            ], names=["doc_id", "n_shingles", "high", "low", "registers"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, high bigint, low bigint, registers binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(bucket, class): one row per class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array([np.uint64(0x100000001B3)] * BAND, np.uint64).cumprod()
        for batch in slices(batches, 4096):
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            band = sketch[:, :BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64) + np.uint64(1)
            code = (band * weights).sum(2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            code = (code ^ (code >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([
                pa.array(code.reshape(-1).view(np.int64)), pa.array(np.repeat(np.array(batch.column(0).to_pylist(), np.int64), BANDS)),
            ], names=["bucket", "cls"])

    return classes.select("cls", "registers").mapInArrow(run, "bucket bigint, cls bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = cut_lineage(sketch_documents(docs, words, key, text))
    classes = cut_lineage(rows.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low").agg(
        F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")))
    joined = component_of_classes(docs, classes, words, percent, key, text)
    labelled = classes.select("high", "low", "cls").join(joined, F.col("vertex") == F.col("cls"), "left").select(
        "high", "low", F.coalesce("component", "cls").alias("component_id"))
    with_set = rows.where("n_shingles > 0").drop("registers").join(labelled, ["high", "low"], "left")
    without = rows.where("n_shingles = 0").select("*", F.col("doc_id").alias("component_id"))
    columns = ("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return with_set.select(*columns).unionByName(without.select(*columns))


def component_of_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(vertex, component) of every class with a link to another class."""
    level = percent / 100 - MARGIN
    keys = cut_lineage(band_keys(classes))
    met = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_met")).where("n_met > 1")
    members = keys.join(met, "bucket").withColumn("blocks", F.ceil(F.col("n_met") / BLOCK_ROWS).cast("bigint"))
    sketched = members.join(classes.select("cls", "n", "registers"), "cls")
    units = with_units(sketched, "blocks").select("bucket", "unit", "side", "cls", "n", "registers")
    schema = "a bigint, b bigint"
    maybe = units.repartition("bucket", "unit").sortWithinPartitions("bucket", "unit").mapInArrow(_link_task(candidate_links, level, percent), schema)
    groups = cut_lineage(connected_components(maybe))

    sizes = groups.join(classes.select(F.col("cls").alias("vertex"), "n"), "vertex").groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("bigint").alias("blocks"))
    wanted = groups.join(sizes, "component").select(F.col("vertex").alias("cls"), F.col("component").alias("grp"), "blocks")
    wanted = wanted.join(classes.select("cls", "registers", "high", "low"), "cls")
    texts = docs.select(F.col(key).cast("bigint").alias("cls"), F.col(text).alias("text"))
    full = full_sets(texts.join(wanted, "cls"), words)
    units = with_units(full, "blocks").select("grp", "unit", "side", "cls", "registers", "codes")
    links = units.repartition("grp", "unit").sortWithinPartitions("grp", "unit").mapInArrow(_link_task(verified_links, level, percent), schema)
    return connected_components(links)


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """Full shingle set of every class's own text. Rows that share the class's doc_id but have
    another set are left out (their class has its own row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            sets, keep = [], []
            for value, high, low in zip(*(got[c].to_pylist() for c in ("text", "high", "low"))):
                codes = shingle_set(value, words).tobytes()
                digest = xxhash.xxh3_128_intdigest(codes)
                keep.append(high == (digest >> 64) - (1 << 63) and low == (digest & (1 << 64) - 1) - (1 << 63))
                sets.append(codes)
            out = pa.RecordBatch.from_arrays([got["cls"], got["grp"], got["blocks"], got["registers"], pa.array(sets, pa.binary())], names=["cls", "grp", "blocks", "registers", "codes"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return texts.select("cls", "grp", "blocks", "registers", "high", "low", "text").mapInArrow(
        run, "cls bigint, grp bigint, blocks bigint, registers binary, codes binary")


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays (smallest doc_id of each group), all columns."""
    gone = near_duplicates(docs, words, percent, key, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
