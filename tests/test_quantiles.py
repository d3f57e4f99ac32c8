import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from cohortlens.operators.quantiles import average_tie_percent_rank, exact_quantiles


def test_exact_quantiles_light_and_heavy_paths_match_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 500, 3000)]
    rows += [(f"g{i}", float(v)) for i in range(20) for v in rng.normal(0, 10, 7).round(2)]
    rows += [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    probs = {"q10": 0.1, "q50": 0.5, "q80": 0.8}
    expect = pdf.dropna().groupby("g")["v"].quantile(list(probs.values())).unstack()
    for light in (3, 1_000_000):
        got = {r["g"]: r for r in exact_quantiles(df, "v", probs, ["g"], light_distinct=light, buckets=16).collect()}
        assert "nulls" not in got
        for g, row in expect.iterrows():
            for (name, p) in probs.items():
                assert abs(got[g][name] - row[p]) < 1e-9, (light, g, name)
    glob = exact_quantiles(df, "v", {"m": 0.5}, light_distinct=3, buckets=8).collect()[0]["m"]
    assert abs(glob - pdf["v"].dropna().quantile(0.5)) < 1e-9


def test_group_without_a_key_stays_beside_a_heavy_group(spark):
    rows = [("hot", float(v)) for v in range(40)] + [(None, 1.0), (None, 3.0), ("cold", 7.0)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"m": 0.5}, ["g"], light_distinct=5, buckets=4)
    assert {r["g"]: r["m"] for r in got.collect()} == {"hot": 19.5, None: 2.0, "cold": 7.0}


def test_weighted_and_empty_global(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, w bigint")
    assert exact_quantiles(df, "v", {"m": 0.5}, weight_col="w").collect()[0]["m"] == 1.0
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", {"m": 0.5}).collect()[0]["m"] is None


def test_average_tie_percent_rank_matches_pandas(spark):
    vals = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = {r["i"]: r["p"] for r in average_tie_percent_rank(df, "v", "p").collect()}
    expect = pd.Series(vals).rank(pct=True)
    for i, e in enumerate(expect):
        assert (got[i] is None and np.isnan(e)) or abs(got[i] - e) < 1e-12


def test_approximate_options_stay_close(spark):
    from cohortlens.operators import features, rules
    from tests.test_features import frames

    # an odd number of payments: the median is one of them, interpolated or not
    payments = [("odin", f"2024-05-0{i}", v, i) for i, v in enumerate((9.0, 2.0, 4.0, 7.5, 3.0), 1)]
    fr = frames(spark, [("odin", "2024-05-06", 150.0, 1)], payments)
    exact = {r["customer_id"]: r["median_transaction_amount"] for r in features.build_customer_features(fr).collect()}
    approx = {r["customer_id"]: r["median_transaction_amount"] for r in features.build_customer_features(fr, approx_median=True).collect()}
    assert exact == approx and exact["odin"] == 4.0
    feats = features.build_customer_features(fr)
    a = rules.derive_rule_thresholds(feats.withColumn("split", F.lit("train")), approx=True).collect()[0]
    assert a["priority_balance_threshold"] == 150.0 and a["fit_split"] == "train"
