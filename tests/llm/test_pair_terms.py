"""Pairs whose words say nothing alone."""
import random

from pyspark.sql import functions as F

from cohortlens.llm import toxicity
from cohortlens.llm.common import prepare

import cases


def test_pairs_without_marginal_association_are_learned(spark):
    """Toxic: both words or neither, so each word's rate is that of all documents."""
    prepare(spark)
    rng, rows, labels = random.Random(2), [], []
    for i in range(1600):
        words = cases.prose(rng, 12).split()
        kind = i // 4 % 4
        if kind in (1, 3):
            words.insert(5, "blockhead")
        if kind in (2, 3):
            words.insert(9, "northerners")
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind in (0, 3))))
    docs = cases.documents(spark, rows)
    machine = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    truth = dict(labels)
    held = [r for r in toxicity.score(docs, machine).where(toxicity.held_out(F.col("doc_id"))).collect()]
    right = sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.9, right
