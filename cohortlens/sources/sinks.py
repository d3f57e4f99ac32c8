"""Writers: segments, report parts, split files, manifest, memory tables.

Nothing is collected: each output is a distributed write. Folders are written whole
(``overwrite``) or appended; a forget rewrites into a *new* version folder and returns
it, so no job ever overwrites a path it is reading.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import memory as mem


def write_segments(segmented: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per segment, rows sorted by customer inside each file."""
    w = segmented.sortWithinPartitions("segment", "customer_id").write.mode("overwrite").partitionBy("segment")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_report(parts: Mapping[str, DataFrame], path: str, query: str | None = None) -> None:
    """Each report part as JSON lines under ``path/<part>``; an envelope row names them."""
    spark = None
    for name, df in parts.items():
        spark = df.sparkSession
        df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    if spark is not None:
        env = spark.createDataFrame([(query, sorted(parts))], "query string, parts array<string>")
        env.coalesce(1).write.mode("overwrite").json(f"{path}/_envelope")


def write_splits(labelled: DataFrame, path: str) -> None:
    """Customer-disjoint split files: ``path/split=train|validation|test|rejected``."""
    labelled.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A handful of rows (one per split + total): a single JSON file."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def append_memories(saved: Mapping[str, DataFrame], memories_path: str, audit_path: str, batch_key: str) -> None:
    """Both tables of a save under a batch key; a retried batch takes the place of its first attempt.
    (A store with versions and forgets of single users: :mod:`memory_store`.)"""
    for name, path in (("stored", memories_path), ("audit", audit_path)):
        saved[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_key}")


def forget_users(memories_path: str, users: DataFrame, new_path: str, audit_path: str, as_of=None) -> DataFrame:
    """Write the remaining memories to ``new_path`` (the caller swaps the pointer),
    append the audit rows, return this call's deleted counts per user."""
    spark = users.sparkSession
    current = spark.read.parquet(memories_path)
    out = mem.forget(current, users, as_of)
    out["remaining"].write.mode("overwrite").parquet(new_path)
    out["audit"].write.mode("append").parquet(audit_path)
    return out["deleted"]
