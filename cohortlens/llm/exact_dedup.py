"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting white space (space, tab to
carriage return). Every row becomes ``(doc_id, sha-256, length)`` once. A Misra-Gries
summary of ``k`` counters finds the digests that may hold more than ``rows / (k + 1)``
rows; an exact aggregate verifies them and picks their winners. These at most ``k``
winners are broadcast, so rows of hot digests are settled in the map task that reads
them; all other digests take the ordinary shuffled aggregate and join.

Defined cases: a null text counts as empty, so all null, empty and blank texts are one
group; a null ``doc_id`` loses against any other id of the same length; rows repeating
the winner's ``doc_id`` are the same document and carry the same verdict; an empty
table gives an empty result. Only the two named columns are read, so further columns
(whatever their names) do not clash.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

WHITE_SPACE = " \t\n\x0b\x0c\r"
COUNTERS = 1024


def digest_of(text: Column) -> Column:
    """sha-256 (hex) of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "").cast("binary"), 256)


def digest_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per input row: id, digest, code points of the original text."""
    return docs.select(
        F.col(key).alias("doc_id"),
        digest_of(F.col(text)).alias("text_sha256"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n_cp"),
    )


def merge_summary(summary: Counter, more: Counter, k: int) -> Counter:
    """Merge two Misra-Gries summaries: add, then subtract the (k+1)-th largest count."""
    summary.update(more)
    if len(summary) > k:
        cut = sorted(summary.values(), reverse=True)[k]
        summary = Counter({d: c - cut for d, c in summary.items() if c > cut})
    return summary


def frequent_candidates(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` digests, among them every digest with more than 2 * rows / (k + 1) rows.

    Each task keeps ``k`` counters whatever it reads; the summaries are added up, which
    keeps the error of every count below rows / (k + 1)."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: Counter = Counter()
        for batch in batches:
            summary = merge_summary(summary, Counter(batch.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary), pa.string()), pa.array(list(summary.values()), pa.int64())],
            names=["text_sha256", "n"],
        )

    parts = digests.select("text_sha256").mapInArrow(summarise, "text_sha256 string, n bigint")
    totals = parts.groupBy("text_sha256").agg(F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "text_sha256").limit(k).select("text_sha256")


def winners(digests: DataFrame) -> DataFrame:
    """Per digest the row that stays (most code points, then smallest id) and the group size."""
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id")))
    return digests.groupBy("text_sha256").agg(best["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """Verdict per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut_lineage(digest_table(docs, key, text))
    candidates = frequent_candidates(rows, k)
    heavy = cut_lineage(winners(rows.join(F.broadcast(candidates), "text_sha256")))  # at most k rows
    hot = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    cold = rest.join(winners(rest), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def keep_first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (one row per group of equal texts)."""
    verdict = exact_dedup(docs, key, text, k)
    kept = cut_lineage(verdict.where("kept").groupBy(F.col("doc_id").alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha"))
                       .agg(F.count(F.lit(1)).alias("_dedup_n")))

    def match(part: DataFrame) -> Column:
        return docs[key].eqNullSafe(part["_dedup_id"]) & (digest_of(docs[text]) == part["_dedup_sha"])

    single, repeated = kept.where("_dedup_n = 1"), kept.where("_dedup_n > 1")
    if repeated.isEmpty():
        return docs.join(kept, match(kept), "left_semi")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_dedup_row")
    again = docs.join(repeated, match(repeated)).select(repeated["_dedup_sha"], row).groupBy("_dedup_sha").agg(F.first("_dedup_row").alias("_dedup_row"))
    return docs.join(single, match(single), "left_semi").unionByName(again.select("_dedup_row.*"))
