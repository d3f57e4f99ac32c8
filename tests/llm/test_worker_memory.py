"""What the pipeline's Python workers hold."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from cohortlens.llm import decontam, toxicity
from cohortlens.llm.common import prepare

import cases


def design(n=2000, terms=500, m=5000):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, n).astype(np.int32)
    picked = [np.sort(rng.choice(m, rng.integers(0, terms), replace=False)).astype("<i4").tobytes() for _ in range(n)]
    picked[5] = picked[6] = b""
    return labels, picked


def test_fit_orders_rows_without_a_copy_of_them():
    labels, picked = design()
    batches = [pa.RecordBatch.from_arrays([pa.array(labels[at:at + 300]), pa.array(picked[at:at + 300], pa.binary())], names=["label", "picked"])
               for at in range(0, len(picked), 300)]
    size = sum(map(len, picked))
    toxicity.ordered_rows(iter(batches[:1]))
    tracemalloc.start()
    try:
        rows, truth = toxicity.ordered_rows(iter(batches))
        assert tracemalloc.get_traced_memory()[1] < size / 2
    finally:
        tracemalloc.stop()
    assert [(float(y), bytes(r)) for y, r in zip(truth, rows)] == sorted((float(y), b) for y, b in zip(labels, picked))
    machine = toxicity.fit_machine(np.arange(5000), rows, truth, steps=3)
    assert rows == [] and np.isfinite(machine.factors).all()


def test_fit_without_rows():
    rows, truth = toxicity.ordered_rows(iter([]))
    assert toxicity.fit_machine(np.arange(0), rows, truth).bias == -800.0


def test_chi_squared_counts_all_batches():
    labels, picked = design(600, 40, 100)
    batches = toxicity._batches(picked, labels.astype(float), np.random.default_rng(1))
    seen = np.zeros((100, 2))
    for y, b in zip(labels, picked):
        seen[np.frombuffer(b, "<i4"), y] += 1
    n, p = len(labels), labels.sum()
    each = seen.sum(1)
    want = (seen[:, 1] * n - each * p) ** 2 * n / np.maximum(each * (n - each) * p * (n - p), 1.0)
    assert np.array_equal(toxicity._chi2(batches, 100), want)


def test_decontamination_is_one_python_map(spark):
    """Each map in a task has a Python worker of its own, which stays and fills in later steps too."""
    prepare(spark)
    rng = random.Random(4)
    passage = cases.prose(rng, 20)
    docs = cases.documents(spark, [(1, passage), (2, cases.prose(rng, 30)), (3, None)])
    benchmark = spark.createDataFrame([(1, passage)], "item_id int, text string")
    for left in (decontam.remove_contaminated(docs, benchmark), decontam.cut_spans(docs, benchmark)):
        assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert left.schema == docs.schema
    assert [r["doc_id"] for r in decontam.remove_contaminated(docs, benchmark).orderBy("doc_id").collect()] == [2, 3]
