"""Versioned memory store and the committed run."""
import pytest
from pyspark.sql import functions as F

from cohortlens.plans import report
from cohortlens.plans.segmentation import SegmentationRun
from cohortlens.sources import bindings
from cohortlens.sources.memory_store import MemoryStore, folder_names


def test_appends_forgets_and_retries(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "m"), buckets=8)
    assert store.version() == 0 and store.live().count() == 0
    rows = spark.range(200).select(F.concat(F.lit("u"), F.col("id") % 20).alias("user_id"), F.col("id").alias("memory_id"))
    assert store.append(rows.where("memory_id < 120"), "day 1") and store.append(rows.where("memory_id >= 120"), "day 2")
    assert not store.append(rows.where("memory_id < 120"), "day 1") and store.version() == 2 and store.read().count() == 200
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "m/data").rglob("*.parquet") if p.is_file()}
    gone = spark.createDataFrame([("u3",), ("u7",), ("nobody",)], "user_id string")
    assert sorted(map(tuple, store.forget(gone).collect())) == [("nobody", 0), ("u3", 10), ("u7", 10)]
    assert store.read().count() == 180 and store.read().where("user_id IN ('u3', 'u7')").count() == 0
    assert {p: p.stat().st_mtime_ns for p in before} == before, "old files stay as they are"
    touched = {r[0] for r in gone.select(store.bucket()).distinct().collect()}
    kept = {(r["batch"], r["bucket"]) for r in store.live(2).collect() if r["bucket"] not in touched}
    assert kept and kept <= {(r["batch"], r["bucket"]) for r in store.live().collect()}
    assert not store.append(rows.where("memory_id < 120"), "day 1"), "a retried batch does not bring forgotten rows back"
    assert store.read(spark.createDataFrame([("u5",)], "user_id string")).count() == 10 and store.read(version=2).count() == 200


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "m"))
    store.append(spark.createDataFrame([("u", 1)], "user_id string, memory_id int"), "a")
    (tmp_path / "m/versions/v2.parquet").mkdir()
    assert store.version() == 1 and store.read().count() == 1


def test_an_emptied_store_reads_as_no_rows(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = spark.createDataFrame([("u", 1), ("v", 2), (None, 3)], "user_id string, memory_id int")
    users = lambda *names: spark.createDataFrame([(n,) for n in names], "user_id string")
    assert store.append(rows.limit(0), "none") and store.read().columns == rows.columns and store.read().count() == 0
    assert store.append(rows.where("user_id IS NOT NULL"), "a") and store.read().count() == 2
    assert store.read(users("nobody at all")).count() == 0
    assert sorted(map(tuple, store.forget(users("u", "v")).collect())) == [("u", 1), ("v", 1)]
    assert store.read().count() == 0 and store.read().columns == rows.columns and store.read(users("u")).count() == 0
    assert sorted(map(tuple, store.forget(users("u")).collect())) == [("u", 0)]
    assert store.append(rows, "b") and store.read().count() == 3


def test_a_run_is_committed_whole(spark, tmp_path, monkeypatch):
    run = SegmentationRun(bindings.binding_a(spark, "/root/testdata/sf0.001"))
    out = str(tmp_path / "out")
    folder = report.write_run(run, out, "Compare the segments", with_models=False, user_id="u", consent=True)
    assert report.committed_runs(spark, out)[0].endswith(folder.rsplit("/", 1)[-1])
    manifest = {r["table"]: r["rows"] for r in report.read_run(spark, folder, "manifest").collect()}
    assert manifest["segments"] == run.segmented.count() == report.read_run(spark, folder, "segments").count()
    assert manifest["candidates"] == report.read_run(spark, folder, "candidates").count() and manifest["memory_entry"] == 1
    entry = report.read_run(spark, folder, "memory_entry").first()
    assert "Compare" not in str(entry.asDict()) and len(entry["content"]["query_sha256"]) == 64
    lines = {(r["section"], r["name"], r["field"]): r["value"] for r in report.read_run(spark, folder, "report").collect()}
    assert lines["rows_written", "segments", "rows"] == str(manifest["segments"])

    monkeypatch.setattr(report, "report_lines", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        report.write_run(run, out, with_models=False)
    assert len(report.committed_runs(spark, out)) == 1 and len(folder_names(spark, f"{out}/runs")) == 2
    half = next(f"{out}/runs/{r}" for r in folder_names(spark, f"{out}/runs") if not folder.endswith(r))
    with pytest.raises(FileNotFoundError):
        report.read_run(spark, half, "segments")
