"""Bindings of the shared test tables to the four input frames.

Binding A (star schema) and binding B (events) are the two datasets; the raw
single-file shape, the memory rows, the query texts and the event log are derived
from the same tables. Every binding reads whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(c):
    return F.col(c).cast("timestamp")


def binding_a(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers, orders as transactions, balances, line items as product holdings.

    One customer in ten (``c_custkey % 10 = 0``) has null balances on purpose,
    so the missing-history path (``needs_review``) is exercised; all rows are read.
    """
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")

    customers = customer.select(F.col("c_custkey").cast("string").alias("customer_id")).distinct()
    transactions = orders.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        _ts("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("seq"),
    )
    known = lambda balance: F.when(F.col("c_custkey") % 10 != 0, balance)
    last_order = orders.agg(F.max(_ts("o_orderdate")).alias("timestamp"))
    snapshot = customer.crossJoin(F.broadcast(last_order)).select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        "timestamp",
        known(F.col("c_acctbal")).alias("balance"),
        F.col("c_custkey").alias("seq"),
    )
    per_order = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        _ts("o_orderdate").alias("timestamp"),
        known(F.col("c_acctbal") + F.col("o_totalprice") * F.lit(0.01)).alias("balance"),
        F.col("o_orderkey").alias("seq"),
    )
    balances = snapshot.unionByName(per_order)
    holdings = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("p_type").alias("product_name"),
            F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"),
        )
    )
    return {"customers": customers, "balances": balances, "transactions": transactions, "product_holdings": holdings}


def binding_b(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Users of the event stream: purchases are transactions, views are balances
    (null for every tenth user, for the missing-history path); no product holdings."""
    events = table(spark, sf_dir, "events")
    customers = events.select(F.col("user_id").cast("string").alias("customer_id")).distinct()
    purchases = events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("customer_id"), _ts("ts").alias("timestamp"),
        F.col("value").alias("amount"), F.col("event_id").alias("seq"),
    )
    views = events.where(F.col("event_type") == "view").select(
        F.col("user_id").cast("string").alias("customer_id"), _ts("ts").alias("timestamp"),
        F.when(F.col("user_id") % 10 != 0, F.col("value")).alias("balance"), F.col("event_id").alias("seq"),
    )
    holdings = spark.createDataFrame([], "customer_id string, product_name string, status string")
    return {"customers": customers, "balances": views, "transactions": purchases, "product_holdings": holdings}


def time_digits(orderkey):
    """A 1–6 digit HHMMSS number (no leading zeros) derived from an order key."""
    hh = orderkey % 24
    mm = F.floor(orderkey / 24) % 60
    ss = F.floor(orderkey / 1440) % 60
    return (hh * 10000 + mm * 100 + ss).cast("bigint").cast("string")


def raw_bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders ⋈ customer`` rendered as the nine text columns of a raw bank export."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("TransactionID"),
        F.col("c_custkey").cast("string").alias("CustomerID"),
        F.lit(None).cast("string").alias("CustomerDOB"),
        F.col("c_mktsegment").alias("CustGender"),
        F.col("c_nationkey").cast("string").alias("CustLocation"),
        F.col("c_acctbal").cast("string").alias("CustAccountBalance"),
        F.date_format(_ts("o_orderdate"), "d/M/yy").alias("TransactionDate"),
        time_digits(F.col("o_orderkey")).alias("TransactionTime"),
        F.col("o_totalprice").cast("string").alias("TransactionAmount (INR)"),
    )


# Fixed values (test inputs of ours): request phrases put in front of user turns,
# chosen by conv_id % 6 — one per intent, none, and one that mixes intents.
REQUEST_PHRASES = (
    "Which regular customers could convert to priority next? ",
    "Compare the average balance of each segment. ",
    "Explain why these customers were selected. ",
    "Show the dormant customers. ",
    "",
    "Explain and compare the conversion candidates. ",
)

# Fixed values (test inputs of ours): phrases naming a segment, by conv_id % 5.
SEGMENT_PHRASES = (
    "Why is this customer priority? ",
    "Explain the regular group. ",
    "What makes an account dormant? ",
    "Which ones need review? ",
    "",
)

# Fixed values (test inputs of ours): intents written into planning events.
PLANNED_INTENTS = ("segment_customers", "explain_segment", "compare_segments", "recommend_conversion", "forecast_revenue")

# Fixed values (test inputs of ours): steps given to events by event_id % 15 (14: own type).
LOG_STEPS = (
    "query_planning", "data_validation", "data_cleaning_filtering", "feature_extraction",
    "feature_selection", "dimensionality_reduction", "hyperparameter_tuning", "fit_diagnostics",
    "leakage_audit", "model_evaluation", "recommendations", "visualization", "memory_profile", "memory_saved",
)


def _pick(options, index):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a request phrase in front (every user turn of every conversation)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select(
        "conv_id", "turn", F.concat(_pick(REQUEST_PHRASES, F.col("conv_id") % 6), F.col("text")).alias("text")
    )


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return conv.select(
        "conv_id", "turn", F.concat(_pick(SEGMENT_PHRASES, F.col("conv_id") % 5), F.col("text")).alias("text")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as workflow logs: one run per user, a step per event, plan JSON in the
    planning events (some valid, some naming no intent, some not JSON)."""
    ev = table(spark, sf_dir, "events")
    k = F.floor(F.col("event_id") / 15)
    step = F.when(F.col("event_id") % 15 == 14, F.col("event_type")).otherwise(_pick(LOG_STEPS, F.col("event_id") % 15))
    plan = (
        F.when(k % 7 == 3, F.col("props"))
        .when(k % 7 == 5, F.lit("plan unavailable"))
        .otherwise(F.concat(F.lit('{"intent": "'), _pick(PLANNED_INTENTS, k % 5), F.lit('", "requested_outputs": ["segment_counts"]}')))
    )
    return ev.select(
        F.col("user_id").cast("string").alias("run_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        step.alias("step"),
        F.when(step == "query_planning", plan).otherwise(F.col("props")).alias("detail"),
    )


MEMORY_AS_OF = "2024-03-01 00:00:00"
# Fixed values (test inputs of ours): product lists by conv_id % 3 and the offer catalog.
PRODUCT_LISTS = (("card",), ("card", "savings"), ())
OFFER_CATALOG = ("card", "savings", "mortgage")


def memory_user(conv_id):
    return F.concat(F.lit("user-"), (conv_id % 20).cast("string"))


def memory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a memory entry of user ``conv_id % 20``; system turns
    carry no consent."""
    conv = table(spark, sf_dir, "conversations")
    products = F.element_at(
        F.array(*[F.array(*[F.lit(p) for p in ps]).cast("array<string>") for ps in PRODUCT_LISTS]),
        (F.col("conv_id") % 3 + 1).cast("int"),
    )
    empty = F.create_map().cast("map<string,string>")
    return conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("memory_id"),
        memory_user(F.col("conv_id")).alias("user_id"),
        (F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("ts"),
        F.lit("conversation").alias("interaction_type"),
        F.create_map(F.lit("text"), F.col("text"), F.lit("topic"), F.col("role")).alias("content"),
        F.create_map(F.lit("contact_method"), F.when(F.col("conv_id") % 2 == 0, "chat").otherwise("email")).alias("context"),
        F.when(F.col("role") == "assistant", F.create_map(F.lit("satisfaction_score"), (F.col("conv_id") % 5 + 1).cast("string")))
        .otherwise(empty).alias("outcome"),
        (F.col("role") != "system").alias("consented"),
        F.lit(None).cast("string").alias("emotional_state"),
        products.alias("products_mentioned"),
        F.array().cast("array<string>").alias("actions_taken"),
    )


def memory_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per conversation turn: its text, by the conversation's user."""
    conv = table(spark, sf_dir, "conversations")
    query_id = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return conv.select(query_id.alias("query_id"), memory_user(F.col("conv_id")).alias("user_id"), F.col("text").alias("query"))


def forget_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who asked to be forgotten: those with a system turn in any conversation."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    return conv.select(memory_user(F.col("conv_id")).alias("user_id")).distinct()


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory user × the offer catalog; mortgages are not offered (ineligible)."""
    users = table(spark, sf_dir, "conversations").select(memory_user(F.col("conv_id")).alias("user_id")).distinct()
    return users.select("user_id", F.explode(F.array(*[F.lit(p) for p in OFFER_CATALOG])).alias("product")).withColumn(
        "eligible", F.col("product") != "mortgage"
    )
