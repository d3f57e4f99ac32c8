from pyspark.sql import functions as F

from cohortlens.functions import text
from cohortlens.operators import charts, trace


def _route(spark, q):
    return spark.createDataFrame([(q,)], "q string").select(text.route_query(F.col("q")).alias("r")).collect()[0]["r"]


def test_requests_are_routed_by_their_words(spark):
    asked = {
        "Who could we convert?": "recommend_conversion", "COMPARE  both\tgroups, please": "compare_segments", "explain number 12": "explain_segment",
        "explain and compare, then convert": "recommend_conversion", "zzz": "segment_customers", "": "segment_customers",
    }
    got = {q: _route(spark, q) for q in asked}
    assert {q: r["intent"] for q, r in got.items()} == asked
    assert [q for q, r in got.items() if r["needs_human_input"]] == ["zzz", ""]
    assert all(r["reason"] == text.ROUTER_FALLBACK_REASON for q, r in got.items() if r["needs_human_input"])


def test_the_first_plan_of_a_run_names_its_intent(spark):
    rows = [("x", 4, "query_planning", '{"intent": "explain_segment"}'), ("x", 9, "query_planning", '{"intent": "compare_segments"}'),
            ("y", 1, "data_validation", '{"intent": "explain_segment"}'), ("y", 2, "query_planning", "[1]"), ("z", 1, "query_planning", '{"intent": null}'),
            ("w", 1, "query_planning", '{"goal": 1}')]
    log = spark.createDataFrame(rows, "run_id string, sequence int, step string, detail string")
    assert {r["run_id"]: r["planned_intent"] for r in text.planned_intent(log).collect()} == {"x": "explain_segment", "y": None, "z": "None", "w": "unknown"}


def test_annotate_events_sequence_and_registry(spark):
    log = spark.createDataFrame([("r", 2, "2025-01-01 01:00:00", "leakage_audit", "x"), ("r", 1, "2025-01-01 00:00:00", "custom", None)],
                                "run_id string, event_id int, ts string, step string, detail string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = trace.annotate_events(log).orderBy("sequence").collect()
    assert [(r["sequence"], r["agent"], r["tool"], r["detail"]) for r in got] == [
        (1, "orchestrator_agent", "custom", ""), (2, "governance_agent", "leakage_audit", "x")]


def test_chart_tables_of_a_few_rows(spark):
    rows = [("r", "regular", float(v), 1.0, 4) for v in (10, 20, 30, 40, 50, 400)] + [("p", "priority", 7.0, 2.0, 1)]
    seg = spark.createDataFrame(rows, "customer_id string, segment string, avg_balance_90d double, transaction_frequency_monthly double, recency_days int")
    box = {r["segment"]: r for r in charts.boxplot_stats(seg).where("feature = 'avg_balance_90d'").collect()}
    assert (box["regular"]["q1"], box["regular"]["median"], box["regular"]["q3"], box["regular"]["whisker_high"], box["regular"]["outliers"]) == (22.5, 35.0, 47.5, 50.0, 1)
    assert box["priority"]["n"] == 1 and box["priority"]["outliers"] == 0
    points = spark.createDataFrame([("p", 0.5, -1.0), ("stranger", 0.0, 0.0)], "customer_id string, pc1 double, pc2 double")
    assert {r["customer_id"]: r["segment"] for r in charts.pca_points_by_segment(points, seg).collect()} == {"p": "priority", "stranger": None}
