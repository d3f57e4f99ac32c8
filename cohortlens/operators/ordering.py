"""Positions of rows in a sort order without gathering a whole partition in one task.

``row_number() over (partition by p order by o)`` sorts each partition ``p`` inside a
single task; with one hot ``p`` that task holds a third of the data. Here rows are
first counted per ``(p, coarse)`` where ``coarse`` is a *monotone* coarsening of the
order (the hour of a timestamp, a prefix of a text key): those few counts give each
bucket its offset, and rows are numbered only inside their bucket.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def position_within(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    coarse: Column,
    out: str = "position",
    base: int = 1,
) -> DataFrame:
    """Add ``out`` = ``base``-based position of each row inside its partition.

    ``coarse`` must never decrease along ``order_cols`` (ties included), otherwise the
    positions are wrong; ``order_cols`` must give a total order inside a partition.
    """
    p = list(partition_cols)
    b = df.withColumn("_cb", coarse)
    counts = b.groupBy(*p, "_cb").agg(F.count(F.lit(1)).alias("_c"))
    before = (Window.partitionBy(*p) if p else Window.partitionBy()).orderBy("_cb").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*p, "_cb").orderBy(*order_cols)
    # null-safe: rows with a null key or a null bucket keep their place (nulls first)
    named = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*p, "_cb"])], "_off")
    same = F.lit(True)
    for i, c in enumerate([*p, "_cb"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    joined = b.join(named, same)
    return joined.withColumn(out, F.col("_off") + F.row_number().over(inner) - 1 + base).drop("_cb", "_off", *[f"_o{i}" for i in range(len(p) + 1)])


def weight_below(df: DataFrame, group_cols: Sequence[str], value_col: str, weight_col: str) -> DataFrame:
    """Add ``_below`` (weight of the smaller values) and ``_n`` (weight of all) per group.

    ``df`` has one row per (group, value). Rows are dealt to range partitions of (group, value),
    written once; a partition's offset is a prefix sum over the small table of (group, partition)
    weights, and only the values of one partition are sorted together."""
    g = list(group_cols)
    ranged = cut_lineage(df.repartitionByRange(*g, value_col).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*g, "_part").agg(F.sum(weight_col).alias("_pw"))  # a row per partition and group that meet
    upto = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select(*g, "_part", (F.sum("_pw").over(upto) - F.col("_pw")).alias("_off"), F.sum("_pw").over(Window.partitionBy(*g)).alias("_n"))
    inside = Window.partitionBy(*g, "_part").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum(weight_col).over(inside), F.lit(0)))
    return placed.join(offsets, [*g, "_part"]).withColumn("_below", F.col("_off") + F.col("_in")).drop("_part", "_off", "_in")


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], copies: str, small: int = 1_000_000, hot: int = 100_000) -> DataFrame:
    """``df`` left-joined to ``table`` (one row per key, with ``copies``: the rows of ``df`` that have
    it), without a hot key in any shuffle.

    A table of at most ``small`` rows is broadcast. Beyond that the keys with more than ``hot`` rows
    (at most rows / ``hot`` of them) are broadcast and settle their rows on the spot; only the rest
    is shuffled. ``table`` should be a written table; null keys match nothing."""
    k = list(keys)
    values = [c for c in table.columns if c not in k]
    if table.count() <= small:
        return df.join(F.broadcast(table), k, "left")
    heavy = F.broadcast(table.where(F.col(copies) > hot))
    settled = df.join(heavy, k, "inner")
    rest = df.join(heavy.select(*k), k, "left_anti").join(table.where(F.col(copies) <= hot), k, "left")
    return settled.select(*df.columns, *values).unionByName(rest.select(*df.columns, *values))


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    k: int,
    salt: Column,
    salt_buckets: int = 64,
    out: str = "rank",
) -> DataFrame:
    """Rows ranked 1..k inside each group (``order_cols`` must be a total order).

    Two rounds: the best ``k`` of each ``(group, salt bucket)`` survive the first
    window, so even a group holding a third of the rows is ranked by ``salt_buckets``
    tasks; the second window sees at most ``k · salt_buckets`` rows per group.
    """
    g = list(group_cols)
    salted = df.withColumn("_salt", F.abs(F.xxhash64(salt)) % salt_buckets)
    first = salted.withColumn("_r1", F.row_number().over(Window.partitionBy(*g, "_salt").orderBy(*order_cols)))
    survivors = first.where(F.col("_r1") <= k).drop("_r1", "_salt")
    ranked = survivors.withColumn(out, F.row_number().over(Window.partitionBy(*g).orderBy(*order_cols)).cast("bigint"))
    return ranked.where(F.col(out) <= k)
