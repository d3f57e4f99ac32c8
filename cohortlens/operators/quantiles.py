"""Exact linear-interpolated quantiles that stay distributed under key skew.

For a group of ``n`` values sorted ascending (``x_0 … x_{n-1}``) and a probability
``p``: ``h = (n-1)·p``, ``q = x_floor(h) + (h - floor(h))·(x_ceil(h) - x_floor(h))``
(the pandas / SQL ``quantile_cont`` definition).

Plan:

1. ``(group, value) → weight``: a hash aggregate with map-side combine; a hot group is
   spread over many tasks by its values.
2. Per group: ``n`` (rows) and ``d`` (distinct values).
3. Groups with ``d <= light_distinct`` use Spark's ``percentile(value, p, weight)``;
   its map of distinct values is bounded by ``light_distinct``. When no group is
   heavier (one scalar check over the checkpointed step 1), that is the whole plan.
4. The rows of heavier groups are dealt once to ``buckets`` range partitions of (group, value)
   and written. Bucket totals give each bucket's first rank; only the buckets that hold a
   wanted rank are opened, and only inside them are values ranked. No task ever holds a
   whole heavy group, and no row is compared with a list of bounds.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import attach, weight_below

LIGHT_DISTINCT = 200_000
BUCKETS = 256


def _interpolate(lo: Column, hi: Column, frac: Column) -> Column:
    return lo + (hi - lo) * frac


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Mapping[str, float],
    group_cols: Sequence[str] = (),
    weight_col: str | None = None,
    light_distinct: int = LIGHT_DISTINCT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per group (one row in total without groups) with a column per entry of
    ``probs``. NULL values are ignored; a group with no values gets NULLs."""
    g = list(group_cols)
    names = list(probs)
    weight = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    pre = (
        df.where(F.col(value_col).isNotNull())
        .select(*g, F.col(value_col).cast("double").alias("_v"), weight.alias("_w"))
        .groupBy(*g, "_v")
        .agg(F.sum("_w").alias("_w"))
    )
    # Materialised once (reliable checkpoint): every later step reads a short lineage,
    # and the heavy-group test below is one small aggregate over it.
    pre = cut_lineage(pre)
    sizes = pre.groupBy(*g).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_d"))
    percentile_aggs = [F.percentile(F.col("_v"), F.lit(float(probs[k])), F.col("_w")).alias(k) for k in names]
    has_heavy = sizes.where(F.col("_d") > light_distinct).limit(1).count() > 0
    if not has_heavy:
        if g:
            return pre.groupBy(*g).agg(*percentile_aggs)
        return pre.groupBy().agg(*percentile_aggs)

    # at most (distinct values / light_distinct) groups are heavy: small enough to broadcast
    heavy_sizes = cut_lineage(sizes.where(F.col("_d") > light_distinct))
    heavy_groups = F.broadcast(heavy_sizes.select(*g))
    light = pre.join(heavy_groups, g, "left_anti").groupBy(*g).agg(*percentile_aggs) if g else None

    heavy_rows = pre.join(heavy_groups, g, "left_semi") if g else pre
    hb = cut_lineage(heavy_rows.repartitionByRange(buckets, *g, "_v").withColumn("_b", F.spark_partition_id()))
    bucket_tot = hb.groupBy(*g, "_b").agg(F.sum("_w").alias("_bw"))
    by_group = Window.partitionBy(*g).orderBy("_b") if g else Window.orderBy("_b")
    bucket_tot = bucket_tot.withColumn("_bstart", F.sum("_bw").over(by_group) - F.col("_bw"))

    # wanted ranks: floor and ceil of h for every probability
    h_exprs = []
    for k in names:
        h = (F.col("_n") - 1).cast("double") * F.lit(float(probs[k]))
        h_exprs.append(F.struct(F.lit(k).alias("_q"), F.floor(h).alias("_lo"), F.ceil(h).alias("_hi"), (h - F.floor(h)).alias("_frac")))
    wanted = (
        heavy_sizes.select(*g, F.explode(F.array(*h_exprs)).alias("_t"))
        .select(*g, "_t.*")
        .select(*g, "_q", "_frac", F.explode(F.array(
            F.struct(F.lit("lo").alias("_side"), F.col("_lo").alias("_r")),
            F.struct(F.lit("hi").alias("_side"), F.col("_hi").alias("_r")),
        )).alias("_s"))
        .select(*g, "_q", "_frac", "_s._side", "_s._r")
    )
    # a row per wanted rank of a heavy group
    located = cut_lineage((wanted.join(bucket_tot, g) if g else wanted.crossJoin(bucket_tot)).where(
        (F.col("_bstart") <= F.col("_r")) & (F.col("_r") < F.col("_bstart") + F.col("_bw"))
    ))
    opened = hb.join(F.broadcast(located.select(*g, "_b").distinct()), [*g, "_b"], "left_semi")
    in_bucket = Window.partitionBy(*g, "_b").orderBy("_v")
    opened = opened.withColumn("_vstart", F.sum("_w").over(in_bucket) - F.col("_w"))
    picked = (
        located.join(opened.select(*g, "_b", "_v", "_w", "_vstart"), [*g, "_b"])
        .where(
            (F.col("_bstart") + F.col("_vstart") <= F.col("_r"))
            & (F.col("_r") < F.col("_bstart") + F.col("_vstart") + F.col("_w"))
        )
    )
    per_q = picked.groupBy(*g, "_q").agg(
        F.max(F.when(F.col("_side") == "lo", F.col("_v"))).alias("_lo_v"),
        F.max(F.when(F.col("_side") == "hi", F.col("_v"))).alias("_hi_v"),
        F.max("_frac").alias("_frac"),
    )
    heavy = per_q.groupBy(*g).agg(
        *[
            F.max(F.when(F.col("_q") == k, _interpolate(F.col("_lo_v"), F.col("_hi_v"), F.col("_frac")))).alias(k)
            for k in names
        ]
    )
    result = light.unionByName(heavy) if g else heavy
    if not g:
        # a global quantile over no rows is one row of NULLs, as in SQL
        result = result.groupBy().agg(*[F.max(k).alias(k) for k in names])
    return result


def average_tie_percent_ranks(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add the pandas ``rank(pct=True)`` of each of ``columns`` (value column -> new column):
    (values below + (ties + 1) / 2) / non-null count.

    All columns are ranked in one pass over their *distinct* values with their counts
    (:func:`ordering.weight_below`) and looked up (:func:`ordering.attach`, so a value that most
    rows share is never one shuffle key); NULL values get a NULL rank. The value columns must
    be of one type; ranks are within each group ``by`` (never NULL)."""
    g = [*by, "_column"]
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns])
    counts = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").where(F.col("_value").isNotNull()).groupBy(*g, "_value").agg(
        F.count(F.lit(1)).alias("_eq"))
    ranks = cut_lineage(weight_below(counts, g, "_value", "_eq").select(
        *g, "_value", "_eq", ((F.col("_below") + (F.col("_eq") + 1) / 2.0) / F.col("_n")).alias("_rank")))
    for value_col, out_col in columns.items():
        found = ranks.where(F.col("_column") == value_col).select(*by, F.col("_value").alias(value_col), F.col("_eq").alias("_copies"), F.col("_rank").alias(out_col))
        df = attach(df, found, [*by, value_col], "_copies").drop("_copies")
    return df


def average_tie_percent_rank(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """:func:`average_tie_percent_ranks` of one column."""
    return average_tie_percent_ranks(df, {value_col: out_col})
