from pyspark.sql import functions as F

from cohortlens.config import SegmentConfig
from cohortlens.operators import splits
from cohortlens.sources import sinks


def test_segment_report_split_sinks_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("b", "regular", 1.0), ("a", "regular", 2.0), ("c", "dormant", 0.0)],
                                "customer_id string, segment string, avg_balance_90d double")
    sinks.write_segments(seg, str(tmp_path / "seg"))
    back = spark.read.parquet(str(tmp_path / "seg"))
    assert sorted((r["customer_id"], r["segment"]) for r in back.collect()) == [("a", "regular"), ("b", "regular"), ("c", "dormant")]
    sinks.write_report({"counts": seg.groupBy("segment").count()}, str(tmp_path / "rep"), query="q")
    assert spark.read.json(str(tmp_path / "rep/counts")).count() == 2
    raw = spark.createDataFrame([("1", "c1"), ("2", None)], "TransactionID string, CustomerID string")
    from cohortlens.sources.contract import label_raw_split
    lab = label_raw_split(raw)
    sinks.write_splits(lab, str(tmp_path / "splits"))
    parts = {r["split"] for r in spark.read.option("header", True).csv(str(tmp_path / "splits")).collect()}
    assert "rejected" in parts
    sinks.write_manifest(splits.split_manifest(lab, "CustomerID"), str(tmp_path / "man"))
    man = {r["split"]: r["rows"] for r in spark.read.json(str(tmp_path / "man")).collect()}
    assert man["total"] == 2


def test_quota_split_has_exact_sizes(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("customer_id"))
    sizes = {r["split"]: r["customers"] for r in splits.split_sizes(splits.quota_split(df, SegmentConfig())).collect()}
    assert sizes == {"test": 201, "validation": 150, "train": 650}


def test_sorted_helpers(spark):
    from cohortlens.operators import rules
    seg = spark.createDataFrame([("b", "regular"), ("a", "regular"), ("c", "dormant")], "customer_id string, segment string")
    assert [r["customer_id"] for r in rules.sorted_segments(seg).collect()] == ["c", "a", "b"]
    assert [r["customer_id"] for r in splits.sorted_customers(seg.union(seg)).collect()] == ["a", "b", "c"]


def test_forget_returns_this_call_s_counts(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "u"), ("m2", "u"), ("m3", "v")], "memory_id string, user_id string")
    rows.write.parquet(str(tmp_path / "v1"))
    first = sinks.forget_users(str(tmp_path / "v1"), spark.createDataFrame([("u",)], "user_id string"), str(tmp_path / "v2"), str(tmp_path / "audit"))
    assert [tuple(r) for r in first.collect()] == [("u", 2)]
    second = sinks.forget_users(str(tmp_path / "v2"), spark.createDataFrame([("u",), ("v",)], "user_id string"), str(tmp_path / "v3"), str(tmp_path / "audit"))
    assert sorted(tuple(r) for r in second.collect()) == [("u", 0), ("v", 1)]


def test_generated_memory_id_is_one_id(spark):
    import json

    from cohortlens.operators import memory as mem
    schema = ("memory_id string, user_id string, ts timestamp, interaction_type string, content map<string,string>, context map<string,string>, "
              "outcome map<string,string>, consented boolean, emotional_state string, products_mentioned array<string>, actions_taken array<string>")
    saved = mem.save(spark.createDataFrame([(None, "u", None, "query", {"a": "b"}, {}, {}, True, None, [], [])], schema), as_of="2025-01-01 00:00:00")
    stored, audit = saved["stored"].first(), saved["audit"].first()
    assert stored["memory_id"] and json.loads(stored["payload"])["memory_id"] == stored["memory_id"] == json.loads(audit["detail"])["memory_id"]


def test_a_retried_append_does_not_repeat_rows(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "u"), ("m2", "v")], "memory_id string, user_id string")
    for batch in ("1", "1", "2"):
        sinks.append_memories({"stored": rows, "audit": rows.limit(1)}, str(tmp_path / "m"), str(tmp_path / "a"), batch)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4 and spark.read.parquet(str(tmp_path / "a")).count() == 2
