"""The preparation job: exact sizes, whole rows, nothing before its manifest."""
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from cohortlens.config import SegmentConfig
from cohortlens.plans import preparation
from cohortlens.sources.contract import SOURCE_COLUMNS


def export(spark, path, n, hot=0, nulls=0, extra=False):
    ids = [f"k{i}" for i in range(n)] + ["k0"] * hot + [None] * nulls
    rows = [(str(i), c, None, 'a "b", c', "x\ny", "1.0", "1/2/20", "10", "5") for i, c in enumerate(ids)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in SOURCE_COLUMNS))
    (df.withColumn("SPLIT", F.lit("own")) if extra else df).write.parquet(str(path))
    return str(path)


def expected(n, seed=42):
    order = sorted((hashlib.md5(f"{seed}:k{i}".encode()).hexdigest(), f"k{i}") for i in range(n))
    t, v = round(n * 0.2), round(n * 0.15)
    return {k: "test" if i < t else "validation" if i < t + v else "train" for i, (_, k) in enumerate(order)}


@pytest.mark.parametrize("n", [1, 3, 10, 237])
def test_sizes_are_exact_and_customers_stay_whole(spark, tmp_path, n):
    folder = preparation.prepare(spark, export(spark, tmp_path / "in.parquet", n, hot=50, nulls=4), str(tmp_path / "out"))
    got = preparation.read_prepared(spark, folder).select("CustomerID", "split").collect()
    want = expected(n)
    assert len(got) == n + 54 and all(r["split"] == want.get(r["CustomerID"], "rejected") for r in got)
    manifest = {r["split"]: (r["rows"], r["customers"]) for r in preparation.read_manifest(spark, folder).collect()}
    assert manifest["total"] == (n + 54, n) and manifest["rejected"] == (4, 0)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_rows_come_back_unchanged(spark, tmp_path, fmt):
    source = export(spark, tmp_path / "in.parquet", 40, extra=True)
    folder = preparation.prepare(spark, source, str(tmp_path / "out"), SegmentConfig(random_state=7), fmt)
    got = preparation.read_prepared(spark, folder)
    assert sorted(map(tuple, got.select(*[F.col(f"`{c}`") for c in SOURCE_COLUMNS]).fillna("").collect())) == sorted(
        map(tuple, spark.read.parquet(source).select(*[F.col(f"`{c}`") for c in SOURCE_COLUMNS]).fillna("").collect()))
    assert {r["CustomerID"]: r["split"] for r in got.collect()} == expected(40, 7)
    assert preparation.read_manifest(spark, folder).select("seed", "source").distinct().collect() == [(7, source)]


def test_no_customer_at_all(spark, tmp_path):
    folder = preparation.prepare(spark, export(spark, tmp_path / "in.parquet", 0, nulls=3), str(tmp_path / "out"))
    assert {r["split"] for r in preparation.read_prepared(spark, folder).collect()} == {"rejected"}


def test_an_unfinished_job_is_no_output(spark, tmp_path):
    folder = preparation.prepare(spark, export(spark, tmp_path / "in.parquet", 5), str(tmp_path / "out"))
    part = str(tmp_path / "part")
    shutil.copytree(folder, part, ignore=shutil.ignore_patterns("manifest.json"))
    with pytest.raises(FileNotFoundError):
        preparation.read_prepared(spark, part)


def test_a_missing_column_is_named(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as string) as CustomerID").write.parquet(str(tmp_path / "in.parquet"))
    with pytest.raises(ValueError, match="TransactionID"):
        preparation.prepare(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"))
