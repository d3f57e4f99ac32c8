"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Texts are encoded with the ``tokenizers`` library. Ids are replaced by their frequency
rank over the whole corpus (0: most frequent), so most ids fit in one byte. A document's
ranks are written as Stream-VByte: one control byte holds the byte lengths (1 to 4) of
four values, control bytes and data bytes are separate columns. Decoding looks a control
byte's four lengths up in a 256-row numpy table.

A file set is a folder with two Parquet tables: ``ranks`` (rank, id) and ``docs`` (one
row per document: doc_id, part, at, n_tokens, control, data), range-partitioned and
sorted by doc_id. ``at`` is the id position inside the part, so the global start of a
document is a prefix sum over parts (one small row each) plus ``at``; nothing needs a
global running sum. Parquet and Spark's commit make a lost executor's part re-written whole.

Speed comes from a memo in front of the library: at a single blank or line break between
other characters the byte-level pre-tokeniser always starts a new piece, so the parts of a
text between them are encoded independently. A Python worker keeps its memo, of bounded size, from
task to task; a lost or new worker starts afresh. Texts
with other white space, and other kinds of tokenizers, go to the library whole; both ways
give the library's ids.

Defined cases: a null text is empty (only the end id); null doc_ids come first; equal
doc_ids are ordered by their content; an empty table gives empty files.
"""
from __future__ import annotations

import json
import os
import string
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, slices

MEMO_PARTS = 500_000  # distinct parts in each of the two memos of a Python worker
BATCH_BYTES = 8_000_000  # text that is encoded at once
TOGETHER = 64  # documents whose ids are coded or decoded at once

# White space other than the single blank or line break between two other characters
# (Unicode White_Space and the ASCII separators), and NUL, which marks text starts here.
_ODD_SPACE = (
    r"[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$"
)
START = "\0\0"


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MemoEncoder:
    """Ids of the ``tokenizers`` library, with bounded memos of text parts in front of it.

    For a byte-level pre-tokeniser without normaliser, letters (with the blank before them) and
    the ASCII punctuation behind them are two pieces of their own, so a part made of both is the
    library's BPE model run on either; other parts go through the whole library. The model takes
    many pieces in one call where the vocabulary has a byte that no merge uses and no text holds.

    A full memo becomes the earlier one, from which parts met again are taken over, so common
    parts are never learnt twice."""

    def __init__(self, tokenizer_json: str, dtype: str, limit: int = MEMO_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype, self.limit = np.dtype(dtype), limit
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.by_part = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.alphabet = byte_characters()
        self.mark, self.mark_id = self._free_mark(spec["model"])
        self.bare = Tokenizer(self.tokenizer.model)  # the model alone
        size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        raw, width = np.arange(size, dtype=self.dtype).tobytes(), self.dtype.itemsize
        self.raw_id = [raw[i * width:(i + 1) * width] for i in range(size)]
        self.memo: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}  # punctuation

    def _free_mark(self, model: dict) -> tuple[str | None, int]:
        """A byte that UTF-8 never uses, if it is one token and part of no merge."""
        odd = any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if model.get("type") != "BPE" or odd:
            return None, -1
        merged = set().union(*("".join(m) for m in model["merges"]))
        free = [self.alphabet[b] for b in range(0xF8, 0x100) if self.alphabet[b] in model["vocab"] and self.alphabet[b] not in merged]
        return (free[0], model["vocab"][free[0]]) if free else (None, -1)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _mapped(self, text: str) -> str:
        """Pieces, a line break behind each, in the byte-level alphabet."""
        return text.encode().decode("latin-1").translate(self.alphabet)

    def _model(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens (without line breaks) by the BPE model alone."""
        line = self.alphabet[0x0A]
        if self.mark is None:
            model, raw_id = self.tokenizer.model.tokenize, self.raw_id
            mapped = self._mapped("\n".join(pieces)).split(line) if pieces else []
            return [b"".join([raw_id[t.id] for t in model(text)]) for text in mapped]
        calls = [self._mapped("\n".join(pieces[at:at + 100]) + "\n").replace(line, self.mark) for at in range(0, len(pieces), 100)]
        found = [e.ids for e in self.bare.encode_batch_fast(calls, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), self.dtype, sum(map(len, found)))
        ends = np.flatnonzero(ids == self.mark_id) * self.dtype.itemsize
        raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + self.dtype.itemsize])
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of new parts. A part follows a blank, starts with a line break, or (behind ``START``)
        starts a text; only the first kind is encoded with its blank. What lies between its lead and
        its punctuation often repeats in other parts and goes to the model once."""
        texts = pa.array(parts, pa.string())
        begins, line = (pc.starts_with(texts, mark).to_numpy(zero_copy_only=False) for mark in (START, "\n"))
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[:len(texts) + 1].astype(np.int64)
        starts, ends = bounds[:-1] + begins * len(START), bounds[1:]
        stem_ends = bounds[:-1] + pc.binary_length(pc.utf8_rtrim(texts, characters=string.punctuation)).to_numpy()
        stems = cut_strings(texts, starts + line, np.maximum(stem_ends, starts + line))
        plain = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False)
        foreign = np.flatnonzero(~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
        plain[foreign] = [s.isalpha() for s in stems.take(pa.array(foreign)).to_pylist()]
        # plain parts are cut into lead, letters and punctuation, others go to the library whole
        bodies = cut_strings(texts, np.where(plain, starts + line, starts), np.where(plain, stem_ends, ends))
        coded = pc.if_else(pa.array(begins | line), bodies, pc.binary_join_element_wise(" ", bodies, "")).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        to_model = np.zeros(len(pieces), bool)
        to_model[coded.indices.to_numpy()] = plain
        learnt = np.empty(len(pieces), object)
        for chosen, learner in ((to_model, self._model), (~to_model, self._library)):
            learnt[chosen] = as_objects(learner(pieces[chosen].tolist()))
        tails = cut_strings(texts, np.where(plain, stem_ends, ends), ends).dictionary_encode()
        binary = pa.large_binary()
        none = pa.scalar(b"", binary)
        breaks = pc.if_else(pa.array(line & plain), pa.scalar(self._tail_ids(["\n"])[0], binary), none)
        tail_ids = pa.array(self._tail_ids(tails.dictionary.to_pylist()), binary).take(tails.indices)
        return pc.binary_join_element_wise(breaks, pa.array(learnt, binary).take(coded.indices), tail_ids, none).to_numpy(zero_copy_only=False).tolist()

    def _tail_ids(self, tails: list[str]) -> list[bytes]:
        """Ids of runs of ASCII punctuation and of the line break."""
        if len(self.tails) > self.limit:
            self.tails = {"": b""}
        new = [t for t in tails if t not in self.tails and t != "\n"]
        self.tails.update(zip(new, self._model(new)))
        if "\n" not in self.tails:
            self.tails["\n"] = self._library(["\n"])[0]
        return [self.tails[t] for t in tails]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, _ODD_SPACE), pc.equal(texts, "")) if self.by_part else pa.array([True] * len(texts))
        out: list[bytes] = [b""] * len(texts)
        by_library = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, raw in zip(by_library.tolist(), self._library([texts[i].as_py() for i in by_library.tolist()])):
            out[i] = raw
        by_memo = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if len(by_memo):
            for i, raw in zip(by_memo.tolist(), self._by_parts(texts.take(pa.array(by_memo)))):
                out[i] = raw
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from the memos or learnt."""
        known = list(map(self.memo.get, parts))
        missing = [i for i, raw in enumerate(known) if raw is None]
        if self.earlier:
            for i in missing:
                known[i] = self.earlier.get(parts[i])
            new = [i for i in missing if known[i] is None]
        else:
            new = missing
        for i, raw in zip(new, self._learn([parts[i] for i in new])):
            known[i] = raw
        if len(self.memo) + len(missing) > self.limit:
            self.earlier, self.memo = self.memo, {}
        self.memo.update(zip(map(parts.__getitem__, missing), map(known.__getitem__, missing)))
        return known

    def _by_parts(self, texts: pa.Array) -> list[bytes]:
        marked = pc.replace_substring(pc.binary_join_element_wise(START, texts, ""), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        known = pa.array(self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())  # far faster than to_pylist
        at = pc.take(pc.binary_length(known), coded.indices).to_numpy()
        ends = np.concatenate([[0], np.cumsum(at)])
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        raw = memoryview(known.take(coded.indices).buffers()[2] or b"")  # the parts' ids in a row
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def as_objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def cut_strings(texts: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of a string array's data from each start to its end, as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    taken = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together until they hold ``size`` bytes: parts repeat more within them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def kept_encoder(tokenizer_json: str, dtype: str) -> MemoEncoder:
    """The encoder that this Python worker keeps from task to task."""
    kept = sys.__dict__.setdefault("_kept_memo_encoders", {})
    name = (xxhash.xxh3_128_hexdigest(tokenizer_json), dtype)
    if name not in kept:
        kept.clear()  # one tokenizer at a time
        kept[name] = MemoEncoder(tokenizer_json, dtype)
    return kept[name]


def encode_documents(docs: DataFrame, tokenizer_json: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids (end id appended) as zstd-compressed integers."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], dtype).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = kept_encoder(shared.value, dtype), zstandard.ZstdCompressor(level=3)
        for batch in gathered(batches, BATCH_BYTES):
            ids = [b + end for b in encoder.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(b) // len(end) for b in ids], pa.int64()), pa.array([pack.compress(b) for b in ids], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, ids binary")


def token_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of every id over all documents (``vocabulary`` numbers reach the driver)."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(vocabulary, np.int64), zstandard.ZstdDecompressor()
        for batch in slices(batches):
            raw = b"".join(unpack.decompress(b) for b in batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, dtype), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


LENGTHS = np.array([[((control >> shift) & 3) + 1 for shift in (0, 2, 4, 6)] for control in range(256)], np.int64)


def _in_fours(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and where its values lie when every document begins a new control byte."""
    fours = -(-counts // 4)
    ahead = 4 * (np.cumsum(fours) - fours) - (np.cumsum(counts) - counts)
    return fours, np.arange(counts.sum()) + np.repeat(ahead, counts)


def vbyte_encode_many(values: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) of each document; ``values`` holds ``counts`` unsigned 32-bit values of one after the other."""
    values = np.ascontiguousarray(values, "<u4")
    fours, places = _in_fours(counts)
    code = np.zeros(len(values), np.uint8)
    widest = int(values.max()) if len(values) else 0
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if widest > limit:
            code += values > limit
    padded = np.zeros(4 * int(fours.sum()), np.uint8)
    padded[places] = code
    a, b, c, d = padded.reshape(-1, 4).T
    control = (a | b << 2 | c << 4 | d << 6).tobytes()
    columns = int(code.max(initial=0)) + 1
    used = np.arange(columns, dtype=np.uint8) <= code[:, None]
    data = values.view(np.uint8).reshape(-1, 4)[:, :columns][used].tobytes()
    control_ends = np.cumsum(fours).tolist()
    data_ends = np.concatenate([[0], np.cumsum(code + np.int64(1))])[np.cumsum(counts)].tolist()
    return [(control[a:b], data[c:d]) for a, b, c, d in zip([0, *control_ends], control_ends, [0, *data_ends], data_ends)]


def vbyte_decode_many(controls: list[bytes], datas: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ``counts`` values of each (control, data), one document after the other."""
    _, places = _in_fours(counts)
    lengths = LENGTHS[np.frombuffer(b"".join(controls), np.uint8)].reshape(-1)[places]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(datas), np.uint8)
    if not np.array_equal(np.concatenate([[0], ends])[np.cumsum(counts)], np.cumsum([len(d) for d in datas])):
        raise ValueError("control and data bytes disagree")
    starts = ends - lengths
    values = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        values[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    return vbyte_encode_many(values, np.array([len(values)]))[0]


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of (control, data)."""
    return vbyte_decode_many([control], [data], np.array([n]))


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text",
) -> None:
    """Encode ``docs`` and write the file set to ``path`` (a folder all executors share)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer_json = f.read()
    vocabulary = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    encoded = cut_lineage(encode_documents(docs, tokenizer_json, end_id, vocabulary, key, text))
    counts = token_counts(encoded, vocabulary)
    by_rank = np.lexsort((np.arange(vocabulary), -counts))
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, unpack, at = shared.value, zstandard.ZstdDecompressor(), 0
        for batch in slices(batches, TOGETHER):
            sizes = np.array(batch.column(1).to_pylist(), np.int64)
            ids = np.frombuffer(b"".join(unpack.decompress(b) for b in batch.column(2).to_pylist()), dtype)
            pairs = vbyte_encode_many(ranks[ids], sizes)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(3), pa.array(starts), batch.column(1),
                pa.array([c for c, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary()),
            ], names=["doc_id", "part", "at", "n_tokens", "control", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    coded = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        code, f"doc_id {kind}, part int, at bigint, n_tokens bigint, control binary, data binary")
    coded.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all earlier documents), n_tokens and the ids as little-endian
    unsigned 32-bit integers, decoded from the file set."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # one row per vocabulary id
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))
    coded = spark.read.parquet(f"{path}/docs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(  # one row per part file
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = shared.value
        for batch in slices(batches, TOGETHER):
            sizes = np.array(batch.column(2).to_pylist(), np.int64)
            raw = by_rank[vbyte_decode_many(batch.column(3).to_pylist(), batch.column(4).to_pylist(), sizes)].tobytes()
            ends = (4 * np.cumsum(sizes)).tolist()
            ids = [raw[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    rows = coded.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "control", "data")
    return rows.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
