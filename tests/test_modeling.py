import numpy as np
from pyspark.sql import functions as F

from cohortlens.config import SegmentConfig
from cohortlens.operators import clustering, models, splits


FEATURES = ("customer_id string, avg_balance_90d double, min_balance_90d double, balance_stability_90d double, transaction_count_90d bigint, "
            "transaction_frequency_monthly double, avg_transaction_amount double, median_transaction_amount double, recency_days int, "
            "active_product_count bigint, insufficient_balance_history boolean, as_of_date string")


def clients(spark, n):
    """Savers (high balance, few payments) and spenders, in turn; every ninth has no balance."""
    rows = []
    for i in range(n):
        saver, wobble = i % 2 == 0, (i * 37 % 11) / 10
        balance = None if i % 9 == 8 else (5200.0 if saver else 310.0) + 90 * wobble
        count = 2 + i % 3 if saver else 25 + i % 7
        amount = 18.0 + wobble if saver else 64.0 - 3 * wobble
        rows.append((f"client-{i}", balance, balance and balance * 0.7, balance and 12.0 + wobble, count, count / 3, amount, amount - wobble,
                     (40 if saver else 3) + i % 5, i % 4, balance is None, "2024-06-30"))
    return spark.createDataFrame(rows, FEATURES)


def test_two_groups_are_found_and_a_family_without_candidates_is_told_apart(spark):
    number = F.regexp_extract("customer_id", r"(\d+)", 1).cast("int")
    everyone = clients(spark, 60)
    cfg = SegmentConfig(cluster_candidates=(2, 4), kmeans_n_init=(2,), gmm_n_init=1)
    d = models.design_matrix(everyone.where(number < 45), everyone.where(number >= 45), cfg)
    diag = {r["family"]: r for r in models.fit_diagnostics(models.tune_kmeans(d, cfg)).collect()}
    assert diag["kmeans"]["best_params"] == '{"n_clusters": 2, "n_init": 2}' and diag["kmeans"]["train_silhouette"] > 0.4
    assert diag["kmeans"]["candidates_tested"] == 2 and diag["gmm"]["status"] == "fallback_to_rules"
    assert (d.fit_split, d.tuning_splits) == ("unlabelled", "unlabelled")


def test_folds_score_the_two_groups(spark):
    folds = models.cross_validate_stability(clients(spark, 60), SegmentConfig(cv_folds=3, kmeans_n_init=(3,))).collect()
    assert [r["fold"] for r in folds] == [0, 1, 2] and all(r["silhouette"] > 0.2 and r["cv_folds"] == 3 for r in folds)


LINEAGE = "thresholds_fit_split string, selection_fit_split string, pca_fit_split string, tuning_splits string"


def test_a_customer_in_two_splits_fails_the_audit(spark):
    labelled = spark.createDataFrame([("p", "train"), ("q", "train"), ("q", "test"), ("s", "validation"), ("s", "test")], "customer_id string, split string")
    audit = splits.leakage_audit(labelled, spark.createDataFrame([("train", "train", "train", "train,validation")], LINEAGE)).first()
    assert (audit["train_validation"], audit["train_test"], audit["validation_test"], audit["status"]) == (0, 1, 1, "failed")


def test_every_audit_check_can_fail(spark):
    labelled = spark.createDataFrame([("p", "train"), ("q", "validation"), ("s", "test")], "customer_id string, split string")
    good = ("train", "train", "train", "train,validation")
    assert splits.leakage_audit(labelled, spark.createDataFrame([good], LINEAGE)).first()["status"] == "passed"
    for at, bad in enumerate(["validation", "train,test", "unlabelled", "test,train"]):
        row = (*good[:at], bad, *good[at + 1:])
        audit = splits.leakage_audit(labelled, spark.createDataFrame([row], LINEAGE)).first()
        assert audit["status"] == "failed" and sum(not v for v in audit.asDict().values() if isinstance(v, bool)) == 1


def test_artefacts_name_the_splits_they_were_fitted_on(spark):
    from cohortlens.operators import rules, transform

    feats = clients(spark, 30).withColumn("split", F.when(F.col("recency_days") > 20, "train").otherwise("validation"))
    assert rules.derive_rule_thresholds(feats).first()["fit_split"] == "train,validation"
    assert rules.derive_rule_thresholds(feats.where("split = 'validation'")).first()["fit_split"] == "validation"
    assert {r["fit_split"] for r in transform.fit_impute_scale(feats.where("split = 'train'")).collect()} == {"train"}
    assert rules.derive_rule_thresholds(clients(spark, 30)).first()["fit_split"] == "unlabelled"


def test_no_customer_is_left_out_by_default(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("customer_id"))
    assert splits.evaluation_sample(df).count() == 30_000


def test_fit_check_and_selection_rules(spark):
    rows = [("kmeans", '{"k": 2}', 0.05, 0.08, 1.0), ("kmeans", '{"k": 3}', 0.6, 0.4, 1.0), ("kmeans", '{"k": 40}', 0.5, 0.45, 1.0)]
    raw = spark.createDataFrame(rows, "family string, params string, train_silhouette double, validation_silhouette double, train_davies_bouldin double")
    scored = {r["params"]: r for r in models.score_table(raw).collect()}
    assert scored['{"k": 2}']["fit_status"] == "underfitting_risk"
    assert scored['{"k": 3}']["fit_status"] == "overfitting_risk"
    assert abs(scored['{"k": 3}']["selection_score"] - (0.4 - 0.25 * 0.2)) < 1e-12
    best = models.best_per_family(models.score_table(raw)).collect()[0]
    assert best["params"] == '{"k": 40}'


def test_hash_split_is_disjoint_and_covering(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("customer_id"))
    lab = splits.hash_split(df)
    assert lab.count() == 2000 and lab.select("customer_id").distinct().count() == 2000
    sizes = {r["split"]: r["customers"] for r in splits.split_sizes(lab).collect()}
    assert set(sizes) == {"train", "validation", "test"} and 300 < sizes["test"] < 500


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(int(i % 3), [float(x) for x in rng.normal(i % 3, 1, 4)]) for i in range(60)]
    df = spark.createDataFrame(pts, "label int, v array<double>")
    got = clustering.silhouette(df, "v", "label").collect()[0]["silhouette"]
    X = np.array([p[1] for p in pts]); y = np.array([p[0] for p in pts])
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = y == y[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-9


def test_evaluation_sample_prefilter_equals_plain_top_k(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("customer_id"))
    cfg = SegmentConfig(max_evaluation_customers=100)
    got = sorted(r["customer_id"] for r in splits.evaluation_sample(df, cfg).collect())
    order = F.md5(F.concat(F.lit("42:"), F.col("customer_id")))
    plain = sorted(r["customer_id"] for r in df.orderBy(order, "customer_id").limit(100).collect())
    assert got == plain and len(got) == 100


def test_cv_guard_and_one_segment_per_customer(spark):
    small = clients(spark, 10)
    out = models.cv_summary(models.cross_validate_stability(small)).collect()[0]
    assert out["note"] == models.CV_TOO_SMALL and out["mean_silhouette"] is None
    from cohortlens.operators import rules
    feats = clients(spark, 30)
    seg = rules.assign_rule_segments(feats, rules.derive_rule_thresholds(feats))
    per = seg.groupBy("customer_id").count().where("count <> 1").count()
    assert per == 0 and seg.count() == 30
    assert set(r["segment"] for r in seg.select("segment").distinct().collect()) <= set(rules.SEGMENTS)
