"""A memory table in hash buckets of the user, with versions.

Layout under one folder (any Hadoop file system)::

    data/batch=<batch>/bucket=<b>/...     rows of one append or one rewrite
    versions/v<number>.parquet             the live (batch, bucket) pairs, a small table

Data files are never changed or overwritten. A write puts its rows into a new data folder and
then commits the next version; a version counts once Spark has marked it complete, so a job
that dies leaves the store as it was. A write of no rows leaves one empty file in ``bucket=-1``, so
that a store that was emptied still reads, with its columns. An append carries a batch key: repeating it (a retried
batch) changes nothing. A forget rewrites only the buckets of the named users; the files of all
other buckets stay as they are. Two writers that commit the same version number collide and
one of them fails.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import list_names, path_kind

BUCKETS = 64
EMPTY = -1  # bucket of a write without rows


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------ versions
    def version(self) -> int:
        """Number of the last committed version (0: none)."""
        folder = f"{self.path}/versions"
        if path_kind(self.spark, folder) == "missing":
            return 0
        numbers = sorted((int(m.group(1)) for m in (re.fullmatch(r"v(\d+)\.parquet", n) for n in list_names(self.spark, folder)) if m), reverse=True)
        return next((n for n in numbers if "_SUCCESS" in list_names(self.spark, f"{folder}/v{n}.parquet")), 0)

    def live(self, version: int | None = None) -> DataFrame:
        """(batch, bucket) pairs of a version: a row per data folder and bucket."""
        number = self.version() if version is None else version
        if number == 0:
            return self.spark.createDataFrame([], "batch string, bucket int")
        return self.spark.read.parquet(f"{self.path}/versions/v{number}.parquet")

    def _commit(self, pairs: list[tuple[str, int]], version: int) -> None:
        rows = self.spark.createDataFrame(pairs, "batch string, bucket int")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v{version}.parquet")

    def _write(self, rows: DataFrame, batch: str) -> list[tuple[str, int]]:
        """Rows into a data folder of their own; its buckets (without rows: ``EMPTY``)."""
        target = f"{self.path}/data/batch={batch}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        if self._any(target):
            return [(batch, r["bucket"]) for r in self.spark.read.parquet(target).select("bucket").distinct().collect()]
        self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{target}/bucket={EMPTY}")
        return [(batch, EMPTY)]

    def _any(self, target: str) -> bool:
        return any(n.startswith("bucket=") for n in folder_names(self.spark, target))

    def bucket(self):
        return F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ reads and writes
    def read(self, users: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version; with ``users`` only theirs, from their buckets' files. A version without
        such rows gives none, with the store's columns; a store without a version is an error."""
        live = [(r["batch"], r["bucket"]) for r in self.live(version).collect()]  # batches x buckets at most
        if not live:
            raise FileNotFoundError(f"{self.path} holds no version for this reading")
        pairs = [p for p in live if p[1] != EMPTY]
        if users is not None:
            names = users.select(F.col("user_id").cast("string").alias("user_id")).distinct()
            wanted = {r[0] for r in names.select(self.bucket()).distinct().collect()}
            pairs = [p for p in pairs if p[1] in wanted]
        rows = self._rows(pairs or live[:1])
        rows = rows if pairs else rows.limit(0)
        return rows if users is None else rows.join(names, "user_id", "left_semi")

    def _rows(self, pairs: list[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/data/batch={b}/bucket={n}" for b, n in pairs]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("batch", "bucket")

    def append(self, rows: DataFrame, batch_key: str) -> bool:
        """Add rows (user_id and any further columns) under a batch key; False if it is there already."""
        batch = "append-" + re.sub(r"[^A-Za-z0-9_-]", "_", batch_key)
        version = self.version()
        pairs = [(r["batch"], r["bucket"]) for r in self.live(version).collect()]
        applied = {r["batch"] for r in self._applied(version).collect()}
        if batch in applied:
            return False
        self._commit(pairs + self._write(rows, batch), version + 1)
        return True

    def _applied(self, version: int) -> DataFrame:
        """Batches of this and all earlier versions (a forget may have moved their rows)."""
        folder = f"{self.path}/versions"
        if version == 0:
            return self.live(0)
        return self.spark.read.parquet(*[f"{folder}/v{n}.parquet" for n in range(1, version + 1)]).select("batch").distinct()

    def forget(self, users: DataFrame) -> DataFrame:
        """Remove the users' rows; user_id and deleted rows of each (0 for unknown ones)."""
        names = users.select(F.col("user_id").cast("string").alias("user_id")).distinct()
        version = self.version()
        pairs = [(r["batch"], r["bucket"]) for r in self.live(version).collect()]
        touched = {r[0] for r in names.select(self.bucket()).distinct().collect()}
        old = [p for p in pairs if p[1] in touched]
        if not old:
            return names.withColumn("deleted_memory_count", F.lit(0).cast("bigint"))
        rows = self._rows(old)
        counts = rows.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
        kept = self._write(rows.join(names, "user_id", "left_anti"), f"forget-{uuid.uuid4().hex}")
        self._commit([p for p in pairs if p[1] not in touched] + kept, version + 1)
        return names.join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("deleted_memory_count"))


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the sub-folders of a folder (through the Hadoop file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
