"""Workflow event logs annotated as specialist-agent tool calls."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import position_within

# Workflow step → (agent, tool).
STEP_REGISTRY = (
    ("query_planning", "orchestrator_agent", "query_planner"),
    ("data_validation", "data_quality_agent", "data_quality_report"),
    ("data_cleaning_filtering", "data_quality_agent", "clean_and_filter_events"),
    ("feature_extraction", "feature_agent", "build_customer_features"),
    ("feature_selection", "feature_agent", "mutual_information_selection"),
    ("dimensionality_reduction", "feature_agent", "pca_projection"),
    ("hyperparameter_tuning", "model_agent", "tune_kmeans_gmm"),
    ("fit_diagnostics", "model_agent", "fit_diagnostics"),
    ("leakage_audit", "governance_agent", "leakage_audit"),
    ("model_evaluation", "model_agent", "cross_validation_and_test_report"),
    ("recommendations", "recommendation_agent", "priority_candidates"),
    ("visualization", "visualization_agent", "create_visualizations"),
    ("memory_profile", "memory_agent", "build_memory_profile"),
    ("memory_saved", "memory_agent", "save_consent_audit"),
)
DEFAULT_AGENT = "orchestrator_agent"


def step_registry(spark) -> DataFrame:
    return spark.createDataFrame(list(STEP_REGISTRY), "step string, agent string, tool string")


def annotate_events(log: DataFrame, run_col: str = "run_id", order_cols=("ts", "event_id"), coarse=None) -> DataFrame:
    """Per run: 1-based ``sequence`` in (ts, event_id) order, agent and tool from the
    registry (default: orchestrator agent, the step as tool), type and status."""
    coarse = coarse if coarse is not None else F.date_trunc("minute", F.col(order_cols[0]))
    numbered = position_within(log, [run_col], list(order_cols), coarse, out="sequence")
    reg = F.broadcast(step_registry(log.sparkSession).withColumnRenamed("step", "_rstep"))
    step = F.coalesce(F.col("step"), F.lit("unknown"))
    return numbered.join(reg, step == F.col("_rstep"), "left").select(
        run_col,
        "sequence",
        F.lit("agent_tool_call").alias("type"),
        F.coalesce(F.col("agent"), F.lit(DEFAULT_AGENT)).alias("agent"),
        F.coalesce(F.col("tool"), step).alias("tool"),
        step.alias("step"),
        F.coalesce(F.col("detail"), F.lit("")).alias("detail"),
        F.lit("completed").alias("status"),
    )
