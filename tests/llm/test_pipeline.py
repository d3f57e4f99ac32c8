"""The pipeline's stages against brute force, and the registration of its queries."""
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline

import cases

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and "op10_exact_dedup" in entry.oracle_sql()


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        left = corpus_pipeline.cut_lineage(stage(spark, docs, SF_DIR))
        assert left.columns == docs.columns
        got = sorted(r["doc_id"] for r in left.select("doc_id").collect())
        if name == "exact_dedup":
            assert got == sorted(v[0] for v in cases.copies(rows) if v[3])
        if name == "near_dedup":
            assert got == sorted(i for i, c in cases.near_components(rows, 5).items() if i == c)
        if name == "decontaminate":
            assert got == sorted(v[0] for v in cases.contamination(rows, items) if not v[5])
        docs = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.columns == ["doc_id", "n_pieces", "ids"] and last.count() == docs.count()


def test_no_other_module_imports_the_operators():
    root = Path(entry.__file__).parent / "cohortlens"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            text = file.read_text()
            assert ".llm" not in text and "import llm" not in text, file
