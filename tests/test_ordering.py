import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.ordering import attach, position_within, top_k_per_group, weight_below


def _data(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.6 else f"p{rng.randint(0, 9)}", rng.randint(0, 500), i) for i in range(3000)]
    return spark.createDataFrame(rows, "p string, t int, id int")


def test_position_within_equals_row_number(spark):
    df = _data(spark)
    got = position_within(df, ["p"], ["t", "id"], F.floor(F.col("t") / 50), out="pos")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("t", "id")))
    diff = got.join(want, ["p", "t", "id"]).where(F.col("pos") != F.col("rn")).count()
    assert diff == 0 and got.count() == 3000
    glob = position_within(df, [], ["t", "id"], F.floor(F.col("t") / 50), out="pos", base=0)
    assert sorted(r["pos"] for r in glob.collect()) == list(range(3000))


def test_top_k_per_group_equals_plain_window(spark):
    df = _data(spark)
    order = [F.col("t").desc(), F.col("id").asc()]
    got = {(r["p"], r["rank"]): r["id"] for r in top_k_per_group(df, ["p"], order, 7, F.col("id"), salt_buckets=8).collect()}
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy(*order))).where("rank <= 7")
    assert got == {(r["p"], r["rank"]): r["id"] for r in plain.collect()}


def test_rows_with_null_order_keep_a_position(spark):
    df = spark.createDataFrame([("a", None), ("a", 3), ("a", 1), (None, 2)], "p string, t int")
    got = position_within(df, ["p"], ["t"], F.floor(F.col("t") / 2), out="pos").collect()
    assert sorted((str(r["p"]), str(r["t"]), r["pos"]) for r in got) == [("None", "2", 1), ("a", "1", 2), ("a", "3", 3), ("a", "None", 1)]


def test_weight_below_is_the_same_for_any_number_of_ranges(spark):
    rng = random.Random(3)
    values = sorted({rng.randint(0, 900) for _ in range(400)})
    df = spark.createDataFrame([(g, v, v % 5 + 1) for g in "xy" for v in values], "g string, v int, w int")
    total = sum(v % 5 + 1 for v in values)
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = {(r["g"], r["v"]): (r["_below"], r["_n"]) for r in weight_below(df, ["g"], "v", "w").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == {(g, v): (sum(u % 5 + 1 for u in values if u < v), total) for g in "xy" for v in values}
    assert weight_below(df.where("g = 'x'"), [], "v", "w").count() == len(values)


def test_attach_settles_hot_keys_without_a_shuffle_of_theirs(spark):
    rows = spark.createDataFrame([(i, i if i % 3 else 0, "x") for i in range(300)] + [(900, None, "x")], "id int, k int, other string")
    table = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("copies")).withColumn("v", F.col("k") * 2)
    for small, hot in ((1_000, 10), (5, 10), (5, 1_000)):
        got = {r["id"]: (r["k"], r["v"], r["other"]) for r in attach(rows, table, ["k"], "copies", small, hot).collect()}
        assert got == {r["id"]: (r["k"], None if r["k"] is None else 2 * r["k"], "x") for r in rows.collect()}


def test_chronological_split_of_keys_with_a_common_prefix(spark):
    from cohortlens.operators import splits

    rows = [(f"2024-0{1 + i % 3}-01", f"CUST{i:06d}") for i in range(2000)]
    got = {(r["as_of_date"], r["customer_id"]): r["split"] for r in splits.chrono_split(spark.createDataFrame(rows, "as_of_date string, customer_id string")).collect()}
    want = {key: "train" if at < 1300 else "validation" if at < 1600 else "test" for at, key in enumerate(sorted(rows))}
    assert got == want
