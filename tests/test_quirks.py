from pyspark.sql import functions as F

from cohortlens.config import SegmentConfig
from cohortlens.operators import candidates, models, rules, splits

FEAT = ("customer_id string, avg_balance_90d double, transaction_count_90d bigint, transaction_frequency_monthly double, "
        "recency_days int, insufficient_balance_history boolean, as_of_date string")


def test_override_order_review_over_priority_over_dormant(spark):
    feats = spark.createDataFrame([
        ("r", None, 5, 5.0, 1, True, "d"),        # missing history wins over everything
        ("p", 500.0, 5, 5.0, 1, False, "d"),      # priority
        ("pd", 500.0, 5, 5.0, 95, False, "d"),    # would be priority, but dormant wins
        ("z", 10.0, 0, 0.0, 91, False, "d"),      # dormant (no transactions)
        ("g", 10.0, 2, 2.0, 3, False, "d"),       # regular
    ], FEAT)
    thr = spark.createDataFrame([(100.0, 3.0)], "priority_balance_threshold double, priority_frequency_threshold double")
    seg = {r["customer_id"]: (r["segment"], r["fallback_level"], r["assignment_confidence"])
           for r in rules.assign_rule_segments(feats, thr).collect()}
    assert seg == {"r": ("needs_review", 3, "low"), "p": ("priority", 1, "high"), "pd": ("dormant", 1, "high"),
                   "z": ("dormant", 1, "high"), "g": ("regular", 2, "medium")}


def test_raw_gap_comparison_favours_balance_and_normalised_option(spark):
    seg = spark.createDataFrame([("g", 90.0, 2, 1.0, 3, False, "d", "regular")], FEAT + ", segment string")
    thr = spark.createDataFrame([(100.0, 3.0)], "priority_balance_threshold double, priority_frequency_threshold double")
    raw = candidates.score_candidates(seg, thr).collect()[0]
    assert raw["recommended_action"] == candidates.ACTION_BALANCE      # 10 (currency) > 2 (per month)
    norm = candidates.score_candidates(seg, thr, normalised=True).collect()[0]
    assert norm["recommended_action"] == candidates.ACTION_FREQUENCY   # 0.1 < 0.667
    assert abs(raw["priority_gap_score"] - (10 / 100 + 2 / 3)) < 1e-12


def test_too_small_validation_gives_not_evaluated_rows(spark):
    feats = spark.createDataFrame([("a", 1.0, 1, 1.0, 1, False, "d")], FEAT)
    out = {r["family"]: r for r in models.evaluate_unsupervised_models(feats, feats.limit(1)).collect()}
    assert set(out) == {"kmeans", "gmm"}
    assert all(r["status"] == "not_evaluated" and r["reason"] == "validation_set_too_small" and r["candidates_tested"] == 0 for r in out.values())


def test_split_choice_follows_cohort_count(spark):
    one = spark.range(50).select(F.col("id").cast("string").alias("customer_id"), F.lit("2025-01-01").alias("as_of_date"))
    many = one.withColumn("as_of_date", F.when(F.col("customer_id").cast("int") < 25, "2025-01-01").otherwise("2025-02-01"))
    h = splits.split_customers(one)
    c = {r["customer_id"]: r["split"] for r in splits.split_customers(many).collect()}
    assert h.count() == 50
    # chronological: the last cohort (ids 25..49, by text order) holds the test rows
    late = {str(i) for i in range(25, 50)}
    assert {k for k, v in c.items() if v == "test"} <= late
    assert sum(v == "test" for v in c.values()) == 50 - int(50 * 0.8)
