"""Rule thresholds (fitted on the training split) and the rule segmenter."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SegmentConfig
from .quantiles import exact_quantiles
from .splits import fitted_splits

# Segment reasons, levels and confidences.
REASON_PRIORITY = "L1: high maintained balance and transaction frequency"
REASON_DORMANT = "L1: inactive or no recent transactions"
REASON_REVIEW = "L3: missing balance history; human review required"
REASON_REGULAR = "L2: active customer below priority thresholds"

# Per-segment texts (description, retention action, cross-sell list,
# explanation basis and action) and their defaults.
SEGMENT_TEXTS = (
    ("priority",
     "Higher maintained balances and transaction activity; relationship-expansion opportunity.",
     "Protect relationship with service reviews, rewards, and relevant wealth/savings journeys.",
     ["wealth/savings review", "rewards or premium card"],
     "High maintained balance and transaction frequency.",
     "Review relationship expansion and savings/rewards opportunities."),
    ("regular",
     "Active customers below priority thresholds; balance-building and engagement opportunity.",
     "Use savings goals, payroll balance prompts, autopay, card activation, and rewards onboarding.",
     ["savings goal", "autopay/rewards onboarding"],
     "Active behavior below the training-derived priority thresholds.",
     "Consider balance-building and engagement actions."),
    ("dormant",
     "Low recent activity or long recency; retention and re-engagement priority.",
     "Use compliant re-engagement, service assistance, and preference-aware contact controls.",
     ["service assistance", "reactivation journey"],
     "Low recent activity or no recent transactions.",
     "Use compliant re-engagement and service assistance."),
    ("needs_review",
     "Insufficient or ambiguous history; require human review before personalization.",
     None,
     None,
     "Insufficient balance history for a confident assignment.",
     "Route to human review before personalization."),
)
DEFAULT_DESCRIPTION = "Behavioral segment requiring review."
DEFAULT_BASIS = "Unknown segment."
DEFAULT_ACTION = "Request clarification."

SEGMENTS = ("priority", "regular", "dormant", "needs_review")


def segment_text_table(spark) -> DataFrame:
    """Four-row dimension of segment texts (a literal, broadcast in every join)."""
    return spark.createDataFrame(
        list(SEGMENT_TEXTS),
        "segment string, description string, retention_recommendation string, "
        "cross_sell array<string>, basis string, action string",
    )


def round9(c: Column) -> Column:
    return F.round(c, 9)


def derive_rule_thresholds(
    train_features: DataFrame, config: SegmentConfig = SegmentConfig(), approx: bool = False
) -> DataFrame:
    """One row: priority_balance_threshold, priority_frequency_threshold, dormant_days, and
    fit_split, the splits of the rows given (see :func:`splits.fitted_splits`).

    Training rows with a balance history only; both quantiles are exact unless
    ``approx`` (then the ``percentile_approx`` sketch).
    """
    valid = train_features.where(~F.col("insufficient_balance_history"))
    if approx:
        return valid.agg(
            F.percentile_approx("avg_balance_90d", config.priority_balance_percentile, 10_000).alias("priority_balance_threshold"),
            F.percentile_approx("transaction_frequency_monthly", config.priority_frequency_percentile, 10_000).alias("priority_frequency_threshold"),
        ).select("*", F.lit(config.dormant_days).alias("dormant_days")).crossJoin(F.broadcast(fitted_splits(train_features)))
    bal = exact_quantiles(valid, "avg_balance_90d", {"priority_balance_threshold": config.priority_balance_percentile})
    freq = exact_quantiles(valid, "transaction_frequency_monthly", {"priority_frequency_threshold": config.priority_frequency_percentile})
    return bal.crossJoin(freq).select(
        "priority_balance_threshold",
        "priority_frequency_threshold",
        F.lit(config.dormant_days).alias("dormant_days"),
    ).crossJoin(F.broadcast(fitted_splits(train_features)))


def assign_rule_segments(features: DataFrame, thresholds: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Add segment, fallback_level, assignment_confidence, segment_reason.

    Override order: needs_review over priority over dormant over regular. Comparisons
    are made on values rounded to 9 decimals; a missing value never qualifies.
    """
    t = F.broadcast(thresholds.select("priority_balance_threshold", "priority_frequency_threshold"))
    df = features.crossJoin(t)
    dormant = (F.col("recency_days") >= F.lit(config.dormant_days)) | (F.col("transaction_count_90d") == 0)
    dormant = F.coalesce(dormant, F.lit(False))
    priority = F.coalesce(
        (round9(F.col("avg_balance_90d")) >= round9(F.col("priority_balance_threshold")))
        & (round9(F.col("transaction_frequency_monthly")) >= round9(F.col("priority_frequency_threshold"))),
        F.lit(False),
    )
    review = F.coalesce(F.col("insufficient_balance_history"), F.lit(False))
    segment = (
        F.when(review, "needs_review").when(priority & ~dormant, "priority").when(dormant, "dormant").otherwise("regular")
    )
    level = F.when(review, 3).when(dormant | priority, 1).otherwise(2)
    confidence = F.when(review, "low").when(dormant | priority, "high").otherwise("medium")
    reason = (
        F.when(segment == "priority", REASON_PRIORITY)
        .when(segment == "dormant", REASON_DORMANT)
        .when(segment == "needs_review", REASON_REVIEW)
        .otherwise(REASON_REGULAR)
    )
    return df.select(
        *features.columns,
        segment.alias("segment"),
        level.alias("fallback_level"),
        confidence.alias("assignment_confidence"),
        reason.alias("segment_reason"),
    )


def segment_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


PROFILE_COLUMNS = ["avg_balance_90d", "transaction_frequency_monthly", "recency_days", "avg_transaction_amount"]


def segment_profiles(segmented: DataFrame) -> DataFrame:
    """Per segment: customers, mean of four features, description (default for others)."""
    spark = segmented.sparkSession
    agg = segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.avg(F.col(c).cast("double")).alias(f"avg_{c}") for c in PROFILE_COLUMNS],
    )
    texts = F.broadcast(segment_text_table(spark).select("segment", "description"))
    return agg.join(texts, "segment", "left").withColumn(
        "description", F.coalesce(F.col("description"), F.lit(DEFAULT_DESCRIPTION))
    )


def explain_segments(segmented: DataFrame) -> DataFrame:
    """Each segmented row with its explanation basis and action and retention texts."""
    texts = F.broadcast(segment_text_table(segmented.sparkSession))
    return segmented.join(texts, "segment", "left").select(
        "customer_id", "segment", "fallback_level", "assignment_confidence", "segment_reason",
        F.coalesce(F.col("basis"), F.lit(DEFAULT_BASIS)).alias("basis"),
        F.coalesce(F.col("action"), F.lit(DEFAULT_ACTION)).alias("action"),
        F.col("retention_recommendation"),
        F.col("cross_sell"),
    )


def final_test_report(test_features: DataFrame, thresholds: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Segment distribution of the test split under the training thresholds."""
    return segment_counts(assign_rule_segments(test_features, thresholds, config))


def sorted_segments(segmented: DataFrame) -> DataFrame:
    """Segmented rows in (segment, customer_id) order (a range-partitioned global sort)."""
    return segmented.orderBy("segment", "customer_id")
