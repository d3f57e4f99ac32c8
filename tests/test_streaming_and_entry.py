import __spark_entry__ as entry
from pyspark.sql import functions as F

from cohortlens.streaming import events as st


def test_memory_sink_and_clean_stream(spark, tmp_path):
    src = tmp_path / "entries"
    rows = [("m1", "u1", "2025-01-01 00:00:00", "q", True), ("m2", "u1", "2025-01-01 00:00:00", "q", False)]
    df = spark.createDataFrame(rows, "memory_id string, user_id string, ts string, interaction_type string, consented boolean")
    df = df.select("*", F.col("ts").cast("timestamp").alias("t")).drop("ts").withColumnRenamed("t", "ts").select(
        "*", F.create_map().cast("map<string,string>").alias("content"), F.create_map().cast("map<string,string>").alias("context"),
        F.create_map().cast("map<string,string>").alias("outcome"), F.lit(None).cast("string").alias("emotional_state"),
        F.array().cast("array<string>").alias("products_mentioned"), F.array().cast("array<string>").alias("actions_taken"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = st.memory_sink(stream, str(tmp_path / "mem"), str(tmp_path / "audit"), str(tmp_path / "ckpt"), as_of="2025-02-01 00:00:00")
    q.awaitTermination(120)
    assert [r["memory_id"] for r in spark.read.parquet(str(tmp_path / "mem")).collect()] == ["m1"]
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1

    ev = tmp_path / "ev"
    spark.createDataFrame([("a", "2025-01-01", "5", 1), ("a", "2025-01-01", "6", 2), ("b", "2025-01-02", "inf", 3)],
                          "customer_id string, timestamp string, amount string, seq int").write.parquet(str(ev))
    s = spark.readStream.schema("customer_id string, timestamp string, amount string, seq int").parquet(str(ev))
    out = st.clean_event_stream(s, "amount")
    q2 = out.writeStream.format("memory").queryName("cleaned_t").trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert [r["customer_id"] for r in spark.sql("SELECT * FROM cleaned_t").collect()] == ["a"]


def test_entry_and_registry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "segment" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
