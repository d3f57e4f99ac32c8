"""Registered queries of the operators: each applies one operator, with production
parameters, to its whole table and returns one row per input row."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontam, exact_dedup, lexical_search, near_dedup, secrets, sentence_pieces, sharding, substring_dedup, token_counts, token_output, toxicity, warc_zip
from .common import scratch_path, table
from .oracle_sql import SQL

__all__ = ["QUERIES", "SQL", "piece_model"]

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 8
END_ID = 2
BEST = 10
TOKEN_LIMIT = 512


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    token_output.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_output.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "packages"))
    records = warc_zip.read_records(warc_zip.read_index(packages), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.verdicts(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.encode(docs, sentence_pieces.load_model(piece_model()), check=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "decoded_ok")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.budget(counts, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_rows(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_token_files, op2_near_duplicates, op3_jump_shards, op4_toxicity_machine, op5_substring_dedup, op6_warc_packages, op7_decontaminate,
        op8_secret_scan, op9_sentence_pieces,
        op10_exact_dedup, op11_lexical_search, op12_token_counts, op13_conversation_repair,
    )
}
