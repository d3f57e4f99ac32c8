"""Customer-disjoint splits, evaluation sample, manifest and leakage audit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SegmentConfig
from ..functions.hashing import seeded_unit
from ..session import cut_lineage
from .ordering import position_within

SPLITS = ("train", "validation", "test")


def split_label(customer: Column, config: SegmentConfig = SegmentConfig(), null_label: str | None = None) -> Column:
    """Seeded hash bucket of the customer key: test, then validation, else train.

    Row-local (no shuffle, no join); a customer lands in one split wherever its rows are.
    """
    u = seeded_unit(config.random_state, customer)
    test_edge = config.test_fraction
    val_edge = config.test_fraction + config.validation_fraction
    label = F.when(u < F.lit(test_edge), F.lit("test")).when(u < F.lit(val_edge), F.lit("validation")).otherwise(F.lit("train"))
    if null_label is not None:
        label = F.when(customer.isNull(), F.lit(null_label)).otherwise(label)
    return label


def hash_split(features: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    return features.withColumn("split", split_label(F.col("customer_id"), config))


def quota_split(features: DataFrame, config: SegmentConfig = SegmentConfig(), key: str = "customer_id") -> DataFrame:
    """Exact split sizes: customers ordered by seeded md5; the first
    ``ceil(test·n)`` are test, the next ``ceil(validation/(1-test) · rest)`` validation.

    Positions come from :func:`position_within` with the first 4 hex digits of the
    md5 as buckets (a monotone coarsening of the order), so no task ranks all rows.
    """
    h = F.md5(F.concat(F.lit(f"{config.random_state}:"), F.col(key).cast("string")))
    keyed = features.withColumn("_h", h)
    ranked = position_within(keyed, [], ["_h", key], F.substring("_h", 1, 4), out="_pos", base=0)
    total = features.agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    n_test = F.ceil(n * F.lit(config.test_fraction))
    n_val = F.ceil((n - n_test) * F.lit(config.validation_fraction / (1 - config.test_fraction)))
    label = F.when(F.col("_pos") < n_test, "test").when(F.col("_pos") < n_test + n_val, "validation").otherwise("train")
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", label).drop("_h", "_pos", "_n")


def chrono_split(features: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Cut the (as_of_date, customer_id) order at 1 - test - validation and 1 - test.

    The rows are range-partitioned by that order and written; positions come from
    :func:`position_within` with the range number as bucket, so ranges are balanced whatever
    the keys look like and no cohort is ranked inside one task.
    """
    ranged = cut_lineage(features.repartitionByRange("as_of_date", "customer_id").withColumn("_part", F.spark_partition_id()))
    ranked = position_within(ranged, [], ["as_of_date", "customer_id"], F.col("_part"), out="_pos", base=0)
    total = ranged.agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.crossJoin(F.broadcast(total))
    n = F.col("_n")
    test_start = F.greatest(F.lit(1), F.floor(n * F.lit(1 - config.test_fraction)))
    val_start = F.greatest(F.lit(1), F.floor(n * F.lit(1 - config.test_fraction - config.validation_fraction)))
    label = F.when(F.col("_pos") < val_start, "train").when(F.col("_pos") < test_start, "validation").otherwise("test")
    return ranked.withColumn("split", label).drop("_n", "_pos", "_part")


def split_sizes(split_df: DataFrame) -> DataFrame:
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("customers"))


def evaluation_sample(df: DataFrame, config: SegmentConfig = SegmentConfig(), key: str = "customer_id", margin: float = 3.0) -> DataFrame:
    """Exact-size seeded sample: the ``max_evaluation_customers`` rows of smallest
    seeded md5 (all rows when fewer, or when the size is None), a top-k on the hash.

    The md5 order begins with its first 32 bits (``seeded_unit``), so rows below a
    cut-off on that value are a prefix of the order. Keeping only the
    ``margin · k / n`` expected share before the top-k means no task merges
    ``partitions · k`` rows; if fewer than ``k`` rows pass (rare), the plain top-k runs.
    """
    k = config.max_evaluation_customers
    if k is None:
        return df
    order = F.md5(F.concat(F.lit(f"{config.random_state}:"), F.col(key).cast("string")))
    n = df.count()
    if n <= k:
        return df
    cut = min(1.0, margin * k / n)
    pre = df.where(seeded_unit(config.random_state, F.col(key)) < F.lit(cut))
    if cut < 1.0 and pre.count() < k:
        pre = df
    return pre.withColumn("_h", order).orderBy("_h", key).limit(k).drop("_h")


def split_customers(features: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """One snapshot date → seeded hash split by customer; several → chronological."""
    cohorts = features.agg(F.count_distinct("as_of_date").alias("n")).collect()[0]["n"]
    return hash_split(features, config) if cohorts <= 1 else chrono_split(features, config)


def split_manifest(rows: DataFrame, customer_col: str = "customer_id", split_col: str = "split") -> DataFrame:
    """rows and distinct customers per split plus a ``total`` line (ROLLUP)."""
    return (
        rows.rollup(split_col)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(customer_col)).alias("customers"))
        .select(F.coalesce(F.col(split_col), F.lit("total")).alias("split"), "rows", "customers")
    )


def split_overlaps(split_df: DataFrame, customer_col: str = "customer_id", split_col: str = "split") -> DataFrame:
    """One row of pairwise customer overlaps between the three splits (one shuffle)."""
    per_customer = split_df.groupBy(customer_col).agg(
        *[F.max(F.when(F.col(split_col) == s, 1).otherwise(0)).alias(f"_in_{s}") for s in SPLITS]
    )
    pair = lambda a, b: F.sum(F.col(f"_in_{a}") * F.col(f"_in_{b}")).cast("bigint")
    return per_customer.agg(
        F.coalesce(pair("train", "validation"), F.lit(0)).alias("train_validation"),
        F.coalesce(pair("train", "test"), F.lit(0)).alias("train_test"),
        F.coalesce(pair("validation", "test"), F.lit(0)).alias("validation_test"),
    )


def leakage_audit(split_df: DataFrame, lineage: DataFrame) -> DataFrame:
    """Overlaps + five checks + status.

    ``lineage`` has one row with string columns naming the split each fitted artefact
    was fitted on (``thresholds_fit_split``, ``selection_fit_split``, ``pca_fit_split``,
    ``tuning_splits``); the checks compare those, they are not constants.
    """
    ov = split_overlaps(split_df)
    checks = ov.crossJoin(F.broadcast(lineage)).select(
        "train_validation", "train_test", "validation_test",
        ((F.col("train_validation") + F.col("train_test") + F.col("validation_test")) == 0).alias("customer_partitions_disjoint"),
        F.coalesce(F.col("thresholds_fit_split") == "train", F.lit(False)).alias("thresholds_fit_on_training_only"),
        F.coalesce(F.col("selection_fit_split") == "train", F.lit(False)).alias("feature_selection_fit_on_training_only"),
        F.coalesce(F.col("pca_fit_split") == "train", F.lit(False)).alias("pca_fit_on_training_only"),
        F.coalesce((F.length("tuning_splits") > 0) & ~F.col("tuning_splits").rlike("test|unlabelled"), F.lit(False)).alias("test_not_used_for_tuning"),
    )
    all_ok = (
        F.col("customer_partitions_disjoint") & F.col("thresholds_fit_on_training_only")
        & F.col("feature_selection_fit_on_training_only") & F.col("pca_fit_on_training_only")
        & F.col("test_not_used_for_tuning")
    )
    return checks.withColumn("status", F.when(all_ok, "passed").otherwise("failed"))


def fitted_splits(rows: DataFrame) -> DataFrame:
    """One row ``fit_split``: the distinct splits of the rows an artefact is fitted on, sorted and
    joined by commas; ``unlabelled`` where the rows carry no split column."""
    if "split" not in rows.columns:
        return rows.sparkSession.createDataFrame([("unlabelled",)], "fit_split string")
    labels = rows.select(F.coalesce("split", F.lit("unlabelled")).alias("split")).distinct()  # a few rows
    return labels.agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("fit_split"))


def sorted_customers(rows: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """Distinct non-null customer ids in ascending order."""
    return rows.select(customer_col).where(F.col(customer_col).isNotNull()).distinct().orderBy(customer_col)
