"""Helpers shared by the operators: table access, batches, text bytes, hashes."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, ensure_checkpoint_dir

__all__ = ["table", "prepare", "cut_lineage", "scratch_path", "free_name", "slices", "word_hashes", "ascii_words", "ngram_hashes"]

BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, UTC and Arrow batches of at most ``BATCH_ROWS`` rows: a batch
    holds whole texts, so its row count bounds what a Python worker holds at once."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def free_name(df: DataFrame | list[str], name: str) -> str:
    """``name``, with underscores appended until ``df`` (or a list of column names) has no such column (Spark ignores case)."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows (no copy)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased (bytes.lower and
    bytes.split touch ASCII only, so other characters stay as they are)."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``n`` consecutive word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    acc = np.zeros(size, np.uint64)
    for j in range(n):
        acc = (acc ^ hashes[j:j + size]) * _MULT
        acc ^= acc >> np.uint64(31)
    return acc
