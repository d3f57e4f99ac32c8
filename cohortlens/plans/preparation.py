"""The preparation job as one call: a raw export becomes customer-disjoint files of stated sizes.

``prepare`` reads the export once (CSV, ZIP or Parquet), keeps a copy of its nine columns, and
writes the rows as ``split=train|validation|test|rejected`` files. Of ``n`` customers exactly
``round(test_fraction * n)`` are test and ``round(validation_fraction * n)`` validation (a half goes
to the even number), in the order of a seeded md5. The manifest is written last: a job that dies
half-way leaves no output that ``read_prepared`` would see, and a retried one gets a folder of its own.

Sizes are exact without a join: only the two customers at which the order is cut are looked up, and
every row then decides by comparing its own customer's place with theirs. So a customer with a third
of all rows costs nothing extra.

Rows without a customer are ``rejected``; columns beyond the nine are left out; a missing one is an
error; without any customer, all rows are rejected.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SegmentConfig
from ..functions.hashing import seeded_hex
from ..operators.splits import split_manifest
from ..session import cut_lineage
from ..sources.contract import SOURCE_COLUMNS, list_names, read_any
from ..sources.memory_store import folder_names

SPLIT_UNIT = "CustomerID"
PREFIX = 4  # hex digits: at most 65,536 counts


def cut_keys(keys: DataFrame, key: str, seed: int, positions: Sequence[int]) -> dict[int, tuple[str, str]]:
    """(md5, key) at each 0-based position of the seeded order of distinct ``keys``; positions outside
    the order are left out. Counts per md5 prefix name the bucket of a position, and only the rows
    of such buckets are ranked."""
    hashed = keys.select(F.col(key).alias("_k"), seeded_hex(seed, F.col(key)).alias("_h"))
    prefix = F.substring("_h", 1, PREFIX)
    before, wanted = 0, {}
    for r in hashed.groupBy(prefix.alias("_b")).agg(F.count(F.lit(1)).alias("n")).orderBy("_b").collect():
        for p in positions:
            if before <= p < before + r["n"]:
                wanted.setdefault(r["_b"], {})[p - before + 1] = p
        before += r["n"]
    if not wanted:
        return {}
    ranked = hashed.where(prefix.isin(sorted(wanted))).select(
        "_h", "_k", prefix.alias("_b"), F.row_number().over(Window.partitionBy(prefix).orderBy("_h", "_k")).alias("_r"))
    hits = ranked.where(F.concat_ws(":", "_b", "_r").isin([f"{b}:{r}" for b, at in wanted.items() for r in at])).collect()  # a row a position
    return {wanted[r["_b"]][r["_r"]]: (r["_h"], r["_k"]) for r in hits}


def exact_split_label(customers: DataFrame, key: str, config: SegmentConfig = SegmentConfig()) -> Column:
    """Split of a row by its column ``key``, for exact sizes over the distinct ``customers`` (written, no nulls)."""
    n = customers.count()
    n_test, n_validation = round(n * config.test_fraction), round(n * config.validation_fraction)
    cuts = cut_keys(customers, key, config.random_state, (n_test - 1, n_test + n_validation - 1))
    place = F.struct(seeded_hex(config.random_state, F.col(key)).alias("h"), F.col(key).alias("k"))
    upto = lambda p: place <= F.struct(F.lit(cuts[p][0]).alias("h"), F.lit(cuts[p][1]).alias("k")) if p in cuts else F.lit(False)
    return F.when(F.col(key).isNull(), "rejected").when(upto(n_test - 1), "test").when(upto(n_test + n_validation - 1), "validation").otherwise("train")


def prepare(spark: SparkSession, source: str, out: str, config: SegmentConfig = SegmentConfig(), fmt: str = "parquet") -> str:
    """Write copy, split files and manifest below ``out``; returns the job's folder."""
    rows = read_any(spark, source)
    missing = [c for c in SOURCE_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"{source} lacks {', '.join(missing)}")
    folder = f"{out.rstrip('/')}/prepared/{uuid.uuid4().hex}"
    rows.select(*[F.col(f"`{c}`") for c in SOURCE_COLUMNS]).write.parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    customers = cut_lineage(raw.select(SPLIT_UNIT).where(F.col(SPLIT_UNIT).isNotNull()).distinct())
    labelled = raw.withColumn("split", exact_split_label(customers, SPLIT_UNIT, config))
    writer = labelled.write.partitionBy("split")
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(f"{folder}/splits")
    facts = {"seed": config.random_state, "split_unit": SPLIT_UNIT, "source": source, "format": fmt,
             "test_fraction": config.test_fraction, "validation_fraction": config.validation_fraction}
    path = F.when(F.col("split") == "total", f"{folder}/splits").otherwise(F.concat(F.lit(f"{folder}/splits/split="), "split"))
    manifest = split_manifest(labelled.select(SPLIT_UNIT, "split"), SPLIT_UNIT).select(
        "split", "rows", "customers", path.alias("path"), *[F.lit(v).alias(k) for k, v in facts.items()])
    manifest.coalesce(1).write.json(f"{folder}/manifest.json")
    return folder


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row a split and one in total; an error where the job has not ended."""
    if "manifest.json" not in folder_names(spark, folder) or "_SUCCESS" not in list_names(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"{folder} holds no complete preparation")
    return spark.read.json(f"{folder}/manifest.json")


def read_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a complete job with their split."""
    fmt = read_manifest(spark, folder).select("format").first()["format"]
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in (*SOURCE_COLUMNS, "split")))
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.format(fmt).load(f"{folder}/splits")
