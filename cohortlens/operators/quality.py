"""Cleaning of event tables and data-quality counts.

Cleaning order (kept from the reference, it changes results): coerce types → drop
rows without key or time → keep the first row per (customer, time) → drop rows whose
value is missing or infinite. "First" is by an explicit ``seq`` column (ties: smaller
value first, NULL first), never by physical row order.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import nan_to_null, parse_timestamp, to_number

VALUE_COLUMNS = {"balances": "balance", "transactions": "amount"}
EVENT_TABLES = ("balances", "transactions")


def coerce_timestamp(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return parse_timestamp(F.col(name))


def coerce_number(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        c = F.col(name).cast("double")
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
    return to_number(F.col(name))


def typed_events(df: DataFrame, value_col: str) -> DataFrame:
    """(customer_id string, timestamp, value double, seq) with bad values as NULL."""
    seq = F.col("seq") if "seq" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        coerce_timestamp(df, "timestamp").alias("timestamp"),
        coerce_number(df, value_col).alias(value_col),
        seq.alias("seq"),
    )


def clean_events(df: DataFrame, value_col: str) -> DataFrame:
    """Coerce, drop keyless rows, keep first per (customer_id, timestamp), drop bad values.

    The keep-first is an aggregate (``min_by`` on ``(seq, value)``), so duplicates are
    combined map-side before the shuffle and a hot key never gathers in one task.
    """
    typed = typed_events(df, value_col).na.drop(subset=["customer_id", "timestamp"])
    return dedupe_first(typed, value_col)


def dedupe_first(typed: DataFrame, value_col: str) -> DataFrame:
    """Keep-first per (customer_id, timestamp) by (seq, value), then drop bad values."""
    first = typed.groupBy("customer_id", "timestamp").agg(
        F.min_by(F.col(value_col), F.struct(F.col("seq"), F.col(value_col))).alias(value_col)
    )
    return first.where(nan_to_null(F.col(value_col)).isNotNull())


def clean_frames(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(frames)
    for name in EVENT_TABLES:
        out[name] = clean_events(frames[name], VALUE_COLUMNS[name])
    return out


def cleaning_audit(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per event table: input_rows, usable_rows, dropped_rows."""
    parts = []
    for name in EVENT_TABLES:
        raw = frames[name].agg(F.count(F.lit(1)).alias("input_rows"))
        kept = clean_events(frames[name], VALUE_COLUMNS[name]).agg(F.count(F.lit(1)).alias("usable_rows"))
        parts.append(
            raw.crossJoin(kept).select(
                F.lit(name).alias("table_name"),
                "input_rows",
                "usable_rows",
                (F.col("input_rows") - F.col("usable_rows")).alias("dropped_rows"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_of(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Long table (table_name, measure, column_name, value) for one frame:
    row count, full-row duplicates (NULLs equal) and non-zero NULL counts per column."""
    cols = columns or [c for c in df.columns if c != "seq"]
    body = df.select(*cols)
    rows_nulls = body.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"_null_{i}") for i, c in enumerate(cols)],
    )
    dups = (
        body.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("_c"))
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("_dups"))
    )
    stacked = rows_nulls.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("measure"), F.lit(None).cast("string").alias("column_name"), F.col("_rows").alias("value")),
                *[
                    F.struct(F.lit("missing").alias("measure"), F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("value"))
                    for i, c in enumerate(cols)
                ],
            )
        ).alias("m")
    ).select("m.*")
    stacked = stacked.where((F.col("measure") == "rows") | (F.col("value") > 0))
    dup_rows = dups.select(
        F.lit("duplicate_rows").alias("measure"), F.lit(None).cast("string").alias("column_name"), F.col("_dups").alias("value")
    )
    return stacked.unionByName(dup_rows).select(F.lit(name).alias("table_name"), "measure", "column_name", "value")


def data_quality(frames: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        part = quality_of(df, name)
        out = part if out is None else out.unionByName(part)
    return out
