"""The whole run as one call: every output as a table of one committed folder.

``write_run`` computes the segmentation run's outputs and writes each to
``<out>/runs/<run id>/<table>``; row counts are observed while the tables are written. The
manifest (table, rows) is written last. A run counts once its manifest is complete, so a run
that dies half-way is no output: ``last_run`` and ``read_run`` never see it.

Tables: ``segments`` (by segment), ``candidates``, ``profiles``, ``explanations``, ``data_quality``,
``cleaning_audit``, ``split_sizes``, ``thresholds``, ``final_test``, ``boxplot``, and with models
``fit_diagnostics``, ``cross_validation``, ``pca_points``, ``pca_facts``, ``leakage_audit``; always
``events`` (the steps with their detail) and ``report`` (section, name, value), the run in one
small table. With a consenting user, ``memory_entry`` holds the interaction: the query only as
its SHA-256, never its text.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import route_query
from ..operators import charts, models, quality, rules, splits, transform
from ..sources.contract import list_names
from ..sources.memory_store import folder_names
from .segmentation import SegmentationRun

DIGITS = 6


def _lines(section: str, df: DataFrame, name: str, *values: str) -> DataFrame:
    """Rows (section, name, value) of a few columns of a small table; doubles are rounded."""
    rows = []
    for v in values:
        c = F.col(v)
        c = F.round(c, DIGITS) if dict(df.dtypes)[v] == "double" else c
        rows.append(F.struct(F.lit(v).alias("field"), c.cast("string").alias("value")))
    return df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.explode(F.array(*rows)).alias("e")).select("section", "name", "e.field", "e.value")


def model_tables(run: SegmentationRun, key: str = "customer_id") -> dict[str, DataFrame]:
    """Model outputs of a run: fitted on train, scored on validation, projected for all."""
    config = run.config
    train, validation = (splits.evaluation_sample(run.part(p), config) for p in ("train", "validation"))
    design = models.design_matrix(train, validation, config, key)
    coords, ratios, pca_split = models.pca_projection(train, splits.evaluation_sample(run.features, config), design.stats, design.selected, key)
    facts = train.agg(F.count(F.lit(1)).alias("fit_rows")).select(
        F.lit("PCA").alias("method"), F.lit(2).alias("n_components"), F.lit(",".join(design.selected)).alias("selected_features"),
        F.lit(ratios[0]).alias("explained_variance_ratio_1"), F.lit(ratios[1]).alias("explained_variance_ratio_2"), "fit_rows", F.lit(pca_split).alias("fit_split"))
    lineage = run.thresholds.select(
        F.col("fit_split").alias("thresholds_fit_split"), F.lit(design.fit_split).alias("selection_fit_split"),
        F.lit(pca_split).alias("pca_fit_split"), F.lit(design.tuning_splits).alias("tuning_splits"))
    return {
        "fit_diagnostics": models.evaluate_unsupervised_models(train, validation, config),
        "cross_validation": models.cv_summary(models.cross_validate_stability(train, config, key)),
        "pca_points": charts.pca_points_by_segment(coords, run.segmented),
        "pca_facts": facts,
        "leakage_audit": splits.leakage_audit(run.labelled, lineage),
    }


def run_tables(run: SegmentationRun, query: str = "", with_models: bool = True) -> dict[str, DataFrame]:
    """All outputs but ``events`` and ``report``, lazily."""
    tables = {
        "segments": run.segment_customers(), "candidates": run.recommend_conversion(), "profiles": run.compare_segments(),
        "explanations": run.explain_segment(), "data_quality": quality.data_quality(run.frames), "cleaning_audit": quality.cleaning_audit(run.frames),
        "split_sizes": splits.split_sizes(run.labelled), "thresholds": run.thresholds, "final_test": run.final_test_report(),
        "segment_counts": run.segment_counts(), "boxplot": charts.boxplot_stats(run.segmented),
    }
    return tables | (model_tables(run) if with_models else {})


def report_lines(tables: Mapping[str, DataFrame], counts: Mapping[str, int], query: str) -> DataFrame:
    """section, name, field, value: the small tables of a run as one."""
    spark = next(iter(tables.values())).sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(route_query(F.col("q")).alias("r")).select("r.*")
    parts = [
        _lines("query", asked.withColumn("_k", F.lit("intent")), "_k", asked.columns[0]),
        _lines("rows_written", spark.createDataFrame(sorted(counts.items()), "name string, rows bigint"), "name", "rows"),
        _lines("split_sizes", tables["split_sizes"], "split", "customers"),
        _lines("segment_counts", tables["segment_counts"], "segment", "customers"),
        _lines("final_test", tables["final_test"], "segment", "customers"),
        _lines("thresholds", tables["thresholds"], "fit_split", "priority_balance_threshold", "priority_frequency_threshold"),
        _lines("profiles", tables["profiles"], "segment", "customers", *[f"avg_{c}" for c in rules.PROFILE_COLUMNS]),
        _lines("data_quality", tables["data_quality"].withColumn("_k", F.concat_ws(".", "table_name", "measure", "column_name")), "_k", "value"),
        _lines("candidates", tables["candidates"], "customer_id", "priority_gap_score"),
    ]
    if "fit_diagnostics" in tables:
        parts += [
            _lines("fit_diagnostics", tables["fit_diagnostics"], "family", "status", "fit_status", "silhouette_gap", "candidates_tested"),
            _lines("cross_validation", tables["cross_validation"].withColumn("_k", F.lit("folds")), "_k", "cv_folds", "mean_silhouette"),
            _lines("leakage_audit", tables["leakage_audit"].withColumn("_k", F.lit("audit")), "_k", "status"),
            _lines("pca", tables["pca_facts"], "method", "selected_features", "fit_rows", "explained_variance_ratio_1", "explained_variance_ratio_2"),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Steps of a run with the tables that each makes.
STEPS = (
    ("data_validation", ("data_quality",)), ("data_cleaning_filtering", ("cleaning_audit",)), ("feature_extraction", ("segments",)),
    ("feature_selection", ("pca_facts",)), ("dimensionality_reduction", ("pca_points",)), ("hyperparameter_tuning", ("fit_diagnostics",)),
    ("leakage_audit", ("leakage_audit",)), ("model_evaluation", ("cross_validation", "final_test")), ("recommendations", ("candidates",)),
    ("visualization", ("boxplot",)),
)


def write_run(run: SegmentationRun, out: str, query: str = "", with_models: bool = True, user_id: str | None = None, consent: bool = False) -> str:
    """Write all outputs below ``out`` and return the run's folder; nothing counts before its manifest."""
    folder = f"{out.rstrip('/')}/runs/{uuid.uuid4().hex}"
    tables, counts = run_tables(run, query, with_models), {}
    spark = run.thresholds.sparkSession

    def write(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        seen = Observation(name)
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
        counts[name] = seen.get["rows"]
        return spark.read.parquet(f"{folder}/{name}") if counts[name] else df

    written = {name: write(name, df, "segment" if name == "segments" else None) for name, df in tables.items()}
    write("report", report_lines(written, dict(counts), query))
    steps = [(n, step, "; ".join(f"{t}: {counts[t]} rows" for t in made)) for n, (step, made) in enumerate(STEPS) if all(t in counts for t in made)]
    write("events", spark.createDataFrame(steps, "sequence int, step string, detail string"))
    if user_id is not None and consent:
        entry = written["segment_counts"].agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", F.col("customers").cast("string"))))).alias("outcome"))
        write("memory_entry", entry.select(
            F.lit(None).cast("string").alias("memory_id"), F.lit(user_id).alias("user_id"), F.current_timestamp().alias("ts"), F.lit("analytics_query").alias("interaction_type"),
            F.create_map(F.lit("topic"), F.lit("analytics_query"), F.lit("query_sha256"), F.lit(hashlib.sha256(query.encode()).hexdigest())).alias("content"),
            F.create_map(F.lit("intent"), F.lit("segmentation_run")).alias("context"), "outcome", F.lit(True).alias("consented"),
            F.lit(None).cast("string").alias("emotional_state"), F.array().cast("array<string>").alias("products_mentioned"),
            F.array(F.lit("segmentation_run")).alias("actions_taken")))
    spark.createDataFrame(sorted(counts.items()), "table string, rows bigint").coalesce(1).write.json(f"{folder}/manifest.json")
    return folder


def committed_runs(spark: SparkSession, out: str) -> list[str]:
    """Folders of the complete runs below ``out``."""
    base = f"{out.rstrip('/')}/runs"
    return [f"{base}/{r}" for r in folder_names(spark, base)
            if "manifest.json" in folder_names(spark, f"{base}/{r}") and "_SUCCESS" in list_names(spark, f"{base}/{r}/manifest.json")]


def read_run(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a complete run."""
    if "_SUCCESS" not in (list_names(spark, f"{folder}/manifest.json") if "manifest.json" in folder_names(spark, folder) else []):
        raise FileNotFoundError(f"{folder} is no complete run")
    return spark.read.json(f"{folder}/manifest.json") if table == "manifest" else spark.read.parquet(f"{folder}/{table}")
