"""Conversion candidates: regular customers closest to the priority thresholds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Action and reason texts.
ACTION_BALANCE = "Offer a savings goal or payroll balance-maintenance journey."
ACTION_FREQUENCY = "Offer autopay, debit-card activation, or rewards onboarding."
CANDIDATE_REASON = "Close to priority threshold; recommendation targets the largest remaining behavior gap."


def score_candidates(segmented: DataFrame, thresholds: DataFrame, normalised: bool = False) -> DataFrame:
    """Every regular customer with its gap score and next action.

    ``normalised=False`` compares the raw gaps (balance units against transactions per
    month) as the reference does; ``True`` compares the normalised gaps.
    """
    t = F.broadcast(thresholds.select("priority_balance_threshold", "priority_frequency_threshold"))
    df = segmented.where(F.col("segment") == "regular").crossJoin(t)
    bt, ft = F.col("priority_balance_threshold"), F.col("priority_frequency_threshold")
    bgap = F.when((bt - F.col("avg_balance_90d")).isNull(), None).otherwise(F.greatest(F.lit(0.0), bt - F.col("avg_balance_90d")))
    fgap = F.when((ft - F.col("transaction_frequency_monthly")).isNull(), None).otherwise(
        F.greatest(F.lit(0.0), ft - F.col("transaction_frequency_monthly"))
    )
    nb, nf = bgap / F.greatest(bt, F.lit(1.0)), fgap / F.greatest(ft, F.lit(1.0))
    cb, cf = (nb, nf) if normalised else (bgap, fgap)
    action = F.when(cb > cf, ACTION_BALANCE).when(cf >= cb, ACTION_FREQUENCY).otherwise("")
    return df.select(
        *segmented.columns,
        (nb + nf).alias("priority_gap_score"),
        action.alias("recommended_action"),
        F.lit(CANDIDATE_REASON).alias("recommendation_reason"),
    )


def priority_candidates(segmented: DataFrame, thresholds: DataFrame, limit: int = 25, normalised: bool = False) -> DataFrame:
    """Top ``limit`` by ascending gap score (ties by customer_id): a top-k, not a sort."""
    scored = score_candidates(segmented, thresholds, normalised)
    return (
        scored.orderBy(F.round("priority_gap_score", 9).asc_nulls_last(), F.col("customer_id"))
        .limit(limit)
        .select("customer_id", "priority_gap_score", "recommended_action", "recommendation_reason")
    )
