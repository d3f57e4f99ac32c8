"""Corpus pipeline: toxicity, exact and near duplicates, benchmark passages, piece ids.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All
stages but the last return rows of ``docs`` with their own columns; the last returns the
piece ids per document. ``run`` writes every stage's result as Parquet to the shared folder
and reads it back.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontam, exact_dedup, near_dedup, sentence_pieces, toxicity
from cohortlens.llm.common import cut_lineage, prepare, table
from cohortlens.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a machine fitted on the labelled ones among them."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    prepare(spark)
    return near_dedup.keep_representatives(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    coded = sentence_pieces.encode(docs.select("doc_id", "text"), sentence_pieces.load_model(piece_model()))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentence_pieces", encode_pieces),
]

# A fitted classifier, shingle links and a tokenizer are beyond SQL; tests/llm compares the
# stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
