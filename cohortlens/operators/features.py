"""Per-customer behaviour features over a lookback window.

Plan shape: the cleaned event tables are aggregated by ``customer_id`` (partial
aggregates combine map-side; the median goes through the skew-safe exact quantile),
then the per-customer sides are left-joined to the customer list on the same key.
The global ``latest`` time is a one-row DataFrame broadcast to every row; with an
explicit ``as_of`` it is a literal and the window filter reaches the Parquet scan.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURE_COLUMNS, SegmentConfig
from ..session import cut_lineage
from .quality import EVENT_TABLES, VALUE_COLUMNS, clean_frames, dedupe_first, typed_events
from .quantiles import exact_quantiles


def latest_event_time(cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``latest``: the later of the two tables' last times (NULL-ignoring)."""
    b = cleaned["balances"].agg(F.max("timestamp").alias("_b"))
    t = cleaned["transactions"].agg(F.max("timestamp").alias("_t"))
    return b.crossJoin(t).select(F.greatest("_b", "_t").alias("latest"))


def _max_micros(tables: Sequence[DataFrame]) -> int | None:
    """Largest ``timestamp`` over the tables as epoch microseconds (one small job)."""
    parts = [t.agg(F.max(F.unix_micros("timestamp")).alias("m")) for t in tables]
    row = parts[0]
    for p in parts[1:]:
        row = row.unionByName(p)
    got = row.agg(F.max("m").alias("m")).collect()[0]["m"]
    return None if got is None else int(got)


def _micros_lit(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


DAY_US = 86_400_000_000


def _cleaned_recent(frames: Mapping[str, DataFrame], lookback_days: int) -> tuple[dict[str, DataFrame], int | None]:
    """Cleaned event tables restricted to what the lookback window can need, plus the
    exact global ``latest`` (epoch µs).

    ``U`` = the last time of any row with key and time (a scan, no shuffle). Grouping
    is by (customer, time), so a time filter commutes with the keep-first step: only
    rows with ``time >= U - 2·lookback`` are deduplicated, once, and written to the
    checkpoint folder. If a surviving row lies at or after ``U - lookback`` the true
    ``latest`` is the last surviving time and its whole window lies inside the kept
    range; otherwise the full history is cleaned instead.
    """
    typed = {n: typed_events(frames[n], VALUE_COLUMNS[n]).na.drop(subset=["customer_id", "timestamp"]) for n in EVENT_TABLES}
    upper = _max_micros(list(typed.values()))
    if upper is None:
        return {n: dedupe_first(typed[n], VALUE_COLUMNS[n]) for n in EVENT_TABLES}, None
    low = upper - 2 * lookback_days * DAY_US
    recent = {n: cut_lineage(dedupe_first(typed[n].where(F.col("timestamp") >= _micros_lit(low)), VALUE_COLUMNS[n])) for n in EVENT_TABLES}
    latest = _max_micros(list(recent.values()))
    if latest is not None and latest >= upper - lookback_days * DAY_US:
        return recent, latest
    full = {n: cut_lineage(dedupe_first(typed[n], VALUE_COLUMNS[n])) for n in EVENT_TABLES}
    return full, _max_micros(list(full.values()))


def customer_list(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("customer_id").cast("string").alias("customer_id")).where(
        F.col("customer_id").isNotNull()
    ).distinct()


def build_customer_features(
    frames: Mapping[str, DataFrame],
    config: SegmentConfig = SegmentConfig(),
    as_of: dt.datetime | None = None,
    approx_median: bool = False,
) -> DataFrame:
    """customer_id, the nine features, as_of_date, insufficient_balance_history.

    ``approx_median=True`` trades the exact median for the mergeable
    ``percentile_approx`` sketch (one partial aggregate, relative rank error ~1e-4).

    Without ``as_of`` the snapshot time is the last usable event (see
    :func:`_cleaned_recent`); with ``as_of`` the window is ``[as_of - lookback, as_of]``
    and both bounds are literals that reach the Parquet scan.
    """
    spark = frames["customers"].sparkSession
    lookback = config.lookback_days
    span = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback))
    if as_of is None:
        cleaned, latest_us = _cleaned_recent(frames, lookback)
        latest_col = _micros_lit(latest_us) if latest_us is not None else F.lit(None).cast("timestamp")
        window = lambda df: df.where(F.col("timestamp") >= latest_col - span)
    else:
        latest_col = F.lit(as_of).cast("timestamp")
        typed = {n: typed_events(frames[n], VALUE_COLUMNS[n]).na.drop(subset=["customer_id", "timestamp"]) for n in EVENT_TABLES}
        bounded = {n: t.where((F.col("timestamp") >= latest_col - span) & (F.col("timestamp") <= latest_col)) for n, t in typed.items()}
        cleaned = {n: dedupe_first(bounded[n], VALUE_COLUMNS[n]) for n in EVENT_TABLES}
        window = lambda df: df
    latest = spark.range(1).select(latest_col.alias("latest"))
    bal = window(cleaned["balances"])
    txn = window(cleaned["transactions"])

    balance_features = bal.groupBy("customer_id").agg(
        F.avg("balance").alias("avg_balance_90d"),
        F.min("balance").alias("min_balance_90d"),
        F.stddev_samp("balance").alias("balance_stability_90d"),
    )
    txn_features = txn.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("transaction_count_90d"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.max("timestamp").alias("last_transaction"),
    )
    if approx_median:
        medians = txn.groupBy("customer_id").agg(
            F.percentile_approx("amount", 0.5, 10_000).alias("median_transaction_amount"))
    else:
        medians = exact_quantiles(txn, "amount", {"median_transaction_amount": 0.5}, ["customer_id"])
    products = (
        frames["product_holdings"].where(F.col("status") == "active")
        .groupBy(F.col("customer_id").cast("string").alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("active_product_count"))
    )
    joined = (
        customer_list(frames["customers"])
        .join(balance_features, "customer_id", "left")
        .join(txn_features, "customer_id", "left")
        .join(medians, "customer_id", "left")
        .join(products, "customer_id", "left")
        .crossJoin(F.broadcast(latest))
    )
    return finish_features(joined, config)


def finish_features(joined: DataFrame, config: SegmentConfig, as_of_col: Column | None = None) -> DataFrame:
    count = F.coalesce(F.col("transaction_count_90d"), F.lit(0)).cast("bigint")
    recency = F.coalesce(
        F.timestamp_diff("DAY", F.col("last_transaction"), F.col("latest")).cast("int"),
        F.lit(config.lookback_days + 1),
    )
    as_of_date = as_of_col if as_of_col is not None else F.date_format("latest", "yyyy-MM-dd")
    return joined.select(
        "customer_id",
        "avg_balance_90d",
        "min_balance_90d",
        "balance_stability_90d",
        count.alias("transaction_count_90d"),
        (count.cast("double") * F.lit(30.0) / F.lit(float(config.lookback_days))).alias("transaction_frequency_monthly"),
        "avg_transaction_amount",
        "median_transaction_amount",
        recency.alias("recency_days"),
        F.coalesce(F.col("active_product_count"), F.lit(0)).cast("bigint").alias("active_product_count"),
        as_of_date.alias("as_of_date"),
        F.col("avg_balance_90d").isNull().alias("insufficient_balance_history"),
    )


def build_features_at(
    frames: Mapping[str, DataFrame],
    as_of_dates: Sequence[dt.date | str],
    config: SegmentConfig = SegmentConfig(),
) -> DataFrame:
    """Features for several snapshot times at once (one row per customer and snapshot).

    Snapshot ``d`` is the instant ``d 00:00`` UTC and sees events in
    ``[d - lookback, d]``, i.e. the single-snapshot rule with ``latest = d``. Each event
    is copied to the snapshots whose window holds it (an ``explode`` of a filtered
    literal array, no join), then aggregated by ``(as_of_date, customer_id)``.
    """
    lookback = config.lookback_days
    # only [first snapshot - lookback, last snapshot] can matter; the bounds are
    # literals (pushed to the scan) and commute with the (customer, time) grouping
    days = sorted(str(d)[:10] for d in as_of_dates)
    lo = F.to_timestamp(F.lit(days[0])) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback))
    hi = F.to_timestamp(F.lit(days[-1]))
    cleaned = {
        n: dedupe_first(
            typed_events(frames[n], VALUE_COLUMNS[n]).na.drop(subset=["customer_id", "timestamp"])
            .where((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi)),
            VALUE_COLUMNS[n],
        )
        for n in EVENT_TABLES
    }
    snap = F.array(*[
        F.struct(F.lit(str(d)[:10]).alias("as_of_date"), F.to_timestamp(F.lit(str(d)[:10])).alias("latest"))
        for d in as_of_dates
    ])
    span = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback))

    def spread(df: DataFrame) -> DataFrame:
        hit = F.filter(snap, lambda s: (F.col("timestamp") <= s["latest"]) & (F.col("timestamp") >= s["latest"] - span))
        return df.select("*", F.explode(hit).alias("_s")).select(
            *df.columns, F.col("_s.as_of_date").alias("as_of_date")
        )

    bal = spread(cleaned["balances"])
    txn = spread(cleaned["transactions"])
    keys = ["as_of_date", "customer_id"]
    balance_features = bal.groupBy(*keys).agg(
        F.avg("balance").alias("avg_balance_90d"),
        F.min("balance").alias("min_balance_90d"),
        F.stddev_samp("balance").alias("balance_stability_90d"),
    )
    txn_features = txn.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count_90d"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.max("timestamp").alias("last_transaction"),
    )
    medians = exact_quantiles(txn, "amount", {"median_transaction_amount": 0.5}, keys)
    products = (
        frames["product_holdings"].where(F.col("status") == "active")
        .groupBy(F.col("customer_id").cast("string").alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("active_product_count"))
    )
    base = customer_list(frames["customers"]).select("customer_id", F.explode(snap).alias("_s")).select(
        "customer_id", F.col("_s.as_of_date").alias("as_of_date"), F.col("_s.latest").alias("latest")
    )
    joined = (
        base.join(balance_features, keys, "left")
        .join(txn_features, keys, "left")
        .join(medians, keys, "left")
        .join(products, "customer_id", "left")
    )
    return finish_features(joined, config, F.col("as_of_date"))


def eligible_feature_matrix(features: DataFrame) -> DataFrame:
    """customer_id + the nine features as doubles, ±inf → NULL."""
    from ..functions.parsing import nan_to_null

    return features.select("customer_id", *[nan_to_null(F.col(c).cast("double")).alias(c) for c in FEATURE_COLUMNS])
