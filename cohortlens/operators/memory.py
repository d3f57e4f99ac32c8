"""Consent-gated interaction memory over many users at once.

Tables (Parquet, append-only except a forget rewrite):

* memories: ``memory_id, user_id, ts, interaction_type, consented, payload,
  cipher_key_id``; ``payload`` is the entry as JSON text with sorted keys, optionally
  AES-encrypted (base64) — the key id says which.
* audit: ``ts, event_type, subject_hash, detail`` — the user id appears only as its
  SHA-256, details are sorted-key JSON.

Search scores a memory as ``10 · |query tokens ∩ memory tokens| + 1 / (1 + age_days)``
and keeps the best ``limit`` per query (ties by memory_id). Tokens are the distinct
``[a-z0-9_]+`` runs longer than 2 characters of the lower-cased text. Inverted lists over
blocks of memories bound what a block can score (see :func:`search`).
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut_lineage
from .ordering import attach, position_within, top_k_per_group

PLAINTEXT_KEY_ID = "development-plaintext"
CONSENT_REFUSAL = "Episodic memory requires explicit consent."
RATIONALE_PRIOR = "Prior interest recorded"
RATIONALE_NONE = "No relevant consented memory"
MAX_ADJUSTMENT = 3

PAYLOAD_SCHEMA = (
    "actions_taken array<string>, consented boolean, content map<string,string>, context map<string,string>, "
    "emotional_state string, interaction_type string, memory_id string, outcome map<string,string>, "
    "products_mentioned array<string>, timestamp string, user_id string"
)


def _sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>")))))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def subject_hash(user: Column) -> Column:
    return F.sha2(user.cast("string"), 256)


def _json_sorted(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(pairs, key=lambda p: p[0])]))


def _as_of(spark, as_of) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()


def payload_json(entries: DataFrame) -> Column:
    """The entry as JSON with sorted keys (nested maps sorted too, NULL fields kept)."""
    fields = F.struct(
        F.coalesce(F.col("actions_taken"), F.array().cast("array<string>")).alias("actions_taken"),
        F.col("consented").alias("consented"),
        _sorted_map(F.col("content")).alias("content"),
        _sorted_map(F.col("context")).alias("context"),
        F.col("emotional_state").alias("emotional_state"),
        F.col("interaction_type").alias("interaction_type"),
        F.col("memory_id").alias("memory_id"),
        _sorted_map(F.col("outcome")).alias("outcome"),
        F.coalesce(F.col("products_mentioned"), F.array().cast("array<string>")).alias("products_mentioned"),
        _iso(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("user_id"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def save(entries: DataFrame, as_of=None, key: str | None = None, key_id: str | None = None) -> dict[str, DataFrame]:
    """Split entries by consent: ``stored`` rows for the memory table, ``rejected``
    rows with the refusal, ``audit`` rows (one ``memory_saved`` per stored row)."""
    consented = F.coalesce(F.col("consented"), F.lit(False))
    refused = entries.where(~consented)
    # a missing id is the hash of the entry: the same in payload, stored and audit rows
    entries = entries.withColumn("memory_id", F.coalesce(F.col("memory_id"), F.sha2(payload_json(entries), 256)))
    text = payload_json(entries)
    if key is not None:
        payload = F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))
        kid = F.lit(key_id or "aes-gcm")
    else:
        payload, kid = text, F.lit(PLAINTEXT_KEY_ID)
    stored = entries.where(consented).select(
        "memory_id", "user_id", F.col("ts"), "interaction_type",
        F.lit(1).alias("consented"), payload.alias("payload"), kid.alias("cipher_key_id"),
    )
    rejected = refused.select("memory_id", "user_id", F.lit(CONSENT_REFUSAL).alias("reason"))
    audit = stored.select(
        _as_of(entries.sparkSession, as_of).alias("ts"),
        F.lit("memory_saved").alias("event_type"),
        subject_hash(F.col("user_id")).alias("subject_hash"),
        _json_sorted(("interaction_type", F.col("interaction_type")), ("memory_id", F.col("memory_id"))).alias("detail"),
    )
    return {"stored": stored, "rejected": rejected, "audit": audit}


def scan(spark, path: str, users: DataFrame | None = None) -> DataFrame:
    """Consented rows of a memory table; with ``users`` only theirs (semi-join; a
    literal ``user_id`` filter on the result reaches the Parquet scan)."""
    rows = spark.read.parquet(path).where(F.col("consented") == 1)
    return rows if users is None else rows.join(users.select("user_id").distinct(), "user_id", "left_semi")


def decode(memories: DataFrame, key: str | None = None) -> DataFrame:
    """Stored rows with the payload parsed back into typed columns."""
    text = F.col("payload")
    if key is not None:
        text = F.when(
            F.col("cipher_key_id") == PLAINTEXT_KEY_ID, text
        ).otherwise(F.aes_decrypt(F.unbase64(text), F.lit(key), F.lit("GCM")).cast("string"))
    p = F.from_json(text, PAYLOAD_SCHEMA)
    return memories.select(
        "memory_id", "user_id", "ts", "interaction_type", "consented", "cipher_key_id",
        p["content"].alias("content"), p["context"].alias("context"), p["outcome"].alias("outcome"),
        p["products_mentioned"].alias("products_mentioned"), p["actions_taken"].alias("actions_taken"),
        p["emotional_state"].alias("emotional_state"),
    )


def searchable_text(content: Column, context: Column, products: Column) -> Column:
    """The searched fields as one text: field names, map keys and values, products."""
    return F.concat_ws(
        " ",
        F.lit("content context products"),
        F.array_join(F.map_keys(content), " "), F.array_join(F.map_values(content), " "),
        F.array_join(F.map_keys(context), " "), F.array_join(F.map_values(context), " "),
        F.array_join(F.coalesce(products, F.array().cast("array<string>")), " "),
    )


def recency(ts: Column, as_of: Column) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)).cast("double") / F.lit(8.64e10))
    return F.lit(1.0) / (F.lit(1.0) + age_days)


def _candidates(decoded: DataFrame, as_of) -> DataFrame:
    return decoded.where(F.col("consented") == 1).select(
        "memory_id", "user_id", "ts",
        recency(F.col("ts"), _as_of(decoded.sparkSession, as_of)).alias("recency"),
        "content", "context", "outcome", "products_mentioned",
    )


BLOCK_MEMORIES = 16_384
PART_QUERIES = 16_384  # queries that one task asks a block
DENSE = 32  # a token in one of so many memories of a block has a row of bytes there


def _memory_blocks(cand: DataFrame, block_rows: int) -> DataFrame:
    """``cand`` with ``block``: a user's memories in blocks of about ``block_rows``, by age. Only counts
    per (user, hour) are ordered; an hour of more rows than a block is cut by a hash."""
    hourly = cand.withColumn("_hour", F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)))
    before = Window.partitionBy("user_id").orderBy(F.col("_hour").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(hourly.groupBy("user_id", "_hour").agg(F.count(F.lit(1)).alias("_n")))
    places = cut_lineage(counts.withColumn("_at", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block_rows)).where(F.col("_hour").isNotNull()))
    cut = F.pmod(F.xxhash64("memory_id"), F.ceil(F.col("_n") / F.lit(block_rows)))
    named = F.concat_ws(":", F.col("user_id"), F.coalesce(F.col("_at"), F.lit(-1)).cast("string"), F.coalesce(cut, F.lit(0)).cast("string"))
    return attach(hourly, places, ["user_id", "_hour"], "_n").withColumn("block", named).drop("_hour", "_n", "_at")


class _BlockIndex:
    """Inverted lists of one block of memories (recency, memory_id, tokens); those of frequent tokens
    are rows of bytes, which add up fast."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: (-r[0], r[1]))
        self.ids, self.ages = [r[1] for r in rows], np.array([r[0] for r in rows])
        lists: dict[str, list[int]] = {}
        for at, (_, _, own) in enumerate(rows):
            for word in own:
                lists.setdefault(word, []).append(at)
        self.rare, self.frequent = {}, {}
        for word, own in lists.items():
            if len(own) * DENSE < len(rows):
                self.rare[word] = np.array(own, np.int32)
            else:
                self.frequent[word] = np.zeros(len(rows), np.uint8)
                self.frequent[word][own] = 1

    def best(self, words: list[str], limit: int, floor: float | None) -> list[tuple]:
        """(memory_id, recency, shared tokens) of the best ``limit`` memories that share a token and score at least ``floor``."""
        rare = [self.rare[w] for w in words if w in self.rare]
        frequent = [self.frequent[w] for w in words if w in self.frequent]
        least = 1.0 if floor is None else max(1.0, (floor - self.ages[0]) / 10 - 1e-6)
        if len(rare) + len(frequent) < least:
            return []
        shared = np.bincount(np.concatenate(rare), minlength=len(self.ids)) if rare else np.zeros(len(self.ids), np.int64)
        for at in range(0, len(frequent), 255):  # as many as a byte can count
            some = frequent[at].copy()
            for row in frequent[at + 1:at + 255]:
                some += row
            shared += some
        near = np.flatnonzero(shared >= least)
        if len(near) > limit:
            at_least = np.cumsum(np.bincount(shared[near])[::-1])  # memories with the most shared tokens, with one less, ...
            near = near[shared[near] >= shared[near].max() - np.searchsorted(at_least, limit)]
        near = near[np.argsort(-shared[near], kind="stable")[:limit]]  # equal ones by age, then id
        found = zip(near.tolist(), self.ages[near].tolist(), shared[near].tolist())
        return [(self.ids[i], age, n) for i, age, n in found if floor is None or 10.0 * n + age >= floor]


def _open_blocks(pairs: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """query_id, memory_id, recency, overlap: the best ``limit`` memories with a shared token of each
    pair (query_id, qt, block, part, floor) that score at least ``floor`` (null: any), from the block's
    inverted lists. ``memories`` has a copy of a block for each of its parts."""
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = memories.select("block", "part", F.lit(0).alias("kind"), empty(pairs.schema["query_id"].dataType, "query_id"), "memory_id", "recency", "mt")
    asked = pairs.where(F.size("qt") > 0).select(
        "block", "part", F.lit(1).alias("kind"), "query_id", empty("string", "memory_id"), F.col("floor").alias("recency"), F.col("qt").alias("mt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, rows, index = None, [], None
        for batch in batches:
            out = []
            for block, part, kind, query, memory, number, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != opened:
                    opened, rows, index = (block, part), [], None
                if kind == 0:
                    rows.append((number, memory, words))
                    continue
                if index is None:
                    index = _BlockIndex(rows) if rows else None
                    rows = []
                if index is not None:
                    out += [(query, *found) for found in index.best(words, limit, number)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (batch.column(3).type, pa.string(), pa.float64(), pa.int64()))], names=["query_id", "memory_id", "recency", "overlap"])

    kind = pairs.schema["query_id"].dataType.simpleString()
    ordered = held.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    return ordered.mapInArrow(run, f"query_id {kind}, memory_id string, recency double, overlap bigint")


def search(decoded: DataFrame, queries: DataFrame, limit: int = 10, as_of=None, block_rows: int = BLOCK_MEMORIES, part_queries: int = PART_QUERIES) -> dict[str, DataFrame]:
    """``queries(query_id, user_id, query)`` → best ``limit`` memories per query
    (``query_id, user_id, rank, memory_id, score``) plus ``audit`` rows.

    Exact, without a pair for every query and memory of a user. A user's memories lie in blocks
    by age. Every query opens the block with the newest memories first; the scores found there are
    a floor for what can still enter the top ``limit``. In each other block it is answered from the
    block's inverted lists: ten times the tokens that they hold, plus the recency of the newest
    memory, bound the block's scores, and only memories that reach the floor leave the task. A block
    with many queries is copied for every ``part_queries`` of them. Memories that share no token can
    only fill up the ranks, the newest first: a user's ``limit`` newest memories stand for them."""
    cand = _candidates(decoded, as_of)
    words = tokens(searchable_text(F.col("content"), F.col("context"), F.col("products_mentioned")))
    memories = cut_lineage(_memory_blocks(cand.select("memory_id", "user_id", "ts", "recency", words.alias("mt")), block_rows))
    asked = cut_lineage(queries.select("query_id", "user_id", tokens(F.col("query")).alias("qt")))

    # a row a user: the newest memories, the blocks (newest first), the parts of its queries
    by_age = [F.col("recency").desc(), F.col("memory_id").asc()]
    recent = top_k_per_group(memories, ["user_id"], by_age, limit, F.col("memory_id"), out="_r").groupBy("user_id").agg(
        F.collect_list(F.struct("memory_id", "recency", "mt")).alias("_recent"))  # limit rows a user
    blocks = memories.groupBy("user_id", "block").agg(F.max("recency").alias("_newest"), F.count(F.lit(1)).alias("_rows")).groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("_newest", "block")), asc=False)["block"].alias("_blocks"), F.sum("_rows").alias("_memories"))
    copies = asked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_queries"))
    users = cut_lineage(recent.join(blocks, "user_id").join(copies, "user_id").withColumn("_parts", F.ceil(F.col("_queries") / F.lit(part_queries)).cast("int")))

    # the newest block, and the newest memories with their own overlap
    score = F.lit(10.0) * F.col("overlap") + F.col("recency")
    part = F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int").alias("part")
    own = attach(asked, users.select("user_id", "_recent", "_blocks", "_parts", "_queries"), ["user_id"], "_queries").where(F.col("_parts").isNotNull())
    held = attach(memories, users.select("user_id", F.col("_blocks")[0].alias("_first"), "_parts", "_memories"), ["user_id"], "_memories").where(
        F.col("_parts").isNotNull()).select("block", "_first", "memory_id", "recency", "mt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    first = own.select("query_id", "qt", F.col("_blocks")[0].alias("block"), part, F.lit(None).cast("double").alias("floor"))
    found = _open_blocks(first, held.where(F.col("block") == F.col("_first")), limit).withColumn("score", score)
    fill = own.select("query_id", "qt", F.explode("_recent").alias("m")).select(
        "query_id", F.col("m.memory_id").alias("memory_id"), F.col("m.recency").alias("recency"),
        F.size(F.array_intersect("qt", "m.mt")).cast("bigint").alias("overlap")).withColumn("score", score)
    found = cut_lineage(found.unionByName(fill).distinct())

    # the other blocks, where a user has more than one
    if not users.where(F.size("_blocks") > 1).isEmpty():
        floor = top_k_per_group(found, ["query_id"], [F.col("score").desc(), F.col("memory_id").asc()], limit, F.col("memory_id"), out="_place").where(
            F.col("_place") == limit).select("query_id", F.col("score").alias("floor"))
        rest = own.where(F.size("_blocks") > 1).select("query_id", "qt", "_blocks", part).join(floor, "query_id", "left").select(
            "query_id", "qt", "part", "floor", F.explode(F.slice("_blocks", F.lit(2), F.size("_blocks") - 1)).alias("block"))
        more = _open_blocks(rest, held.where(F.col("block") != F.col("_first")), limit).withColumn("score", score)
        found = found.unionByName(more).distinct()
    best = top_k_per_group(found, ["query_id"], [F.col("score").desc(), F.col("memory_id").asc()], limit, F.col("memory_id"))
    result = best.join(asked.select("query_id", "user_id"), "query_id").select("query_id", "user_id", "rank", "memory_id", "score")

    per_user = cand.groupBy("user_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    audit = queries.join(per_user, "user_id", "left").select(
        _as_of(decoded.sparkSession, as_of).alias("ts"),
        F.lit("memory_retrieved").alias("event_type"),
        subject_hash(F.col("user_id")).alias("subject_hash"),
        _json_sorted(
            ("candidate_count", F.coalesce(F.col("candidate_count"), F.lit(0)).cast("bigint")),
            ("query_token_count", F.size(tokens(F.col("query"))).cast("bigint")),
        ).alias("detail"),
    )
    return {"results": result, "audit": audit}


def build_profiles(decoded: DataFrame, limit: int = 100, as_of=None) -> DataFrame:
    """Per user, over the ``limit`` most recent consented memories: preferred contact
    method (mode, ties by name), product interest counts, top-5 concerns (count, ties
    by first seen), satisfaction scores in rank order, memory count."""
    cand = _candidates(decoded, as_of)
    top = top_k_per_group(cand, ["user_id"], [F.col("recency").desc(), F.col("memory_id").asc()], limit, F.col("memory_id"))

    contact = F.col("context")["contact_method"]
    contacts = (
        top.where(F.coalesce(contact, F.lit("")) != "")
        .groupBy("user_id", contact.alias("method")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id").agg(F.min_by(F.col("method"), F.struct(-F.col("n"), F.col("method"))).alias("preferred_contact_method"))
    )
    products = (
        top.select("user_id", F.explode("products_mentioned").alias("product"))
        .groupBy("user_id", "product").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product", "n")))).alias("product_interest_counts"))
    )
    topic = F.col("content")["topic"]
    concerns = (
        top.where(F.coalesce(topic, F.lit("")) != "")
        .groupBy("user_id", topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
        .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("first"), F.col("topic")))).alias("_c"))
        .select("user_id", F.slice(F.transform("_c", lambda s: s["topic"]), 1, 5).alias("common_concerns"))
    )
    score = F.col("outcome")["satisfaction_score"].try_cast("double")
    scores = (
        top.where(score.isNotNull())
        .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), score.alias("s")))).alias("_s"))
        .select("user_id", F.transform("_s", lambda x: x["s"]).alias("satisfaction_scores"))
    )
    counts = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("memory_count"))
    return (
        counts.join(contacts, "user_id", "left").join(products, "user_id", "left")
        .join(concerns, "user_id", "left").join(scores, "user_id", "left")
        .select(
            "user_id", "preferred_contact_method",
            F.coalesce("product_interest_counts", F.create_map().cast("map<string,bigint>")).alias("product_interest_counts"),
            F.coalesce("common_concerns", F.array().cast("array<string>")).alias("common_concerns"),
            F.coalesce("satisfaction_scores", F.array().cast("array<double>")).alias("satisfaction_scores"),
            "memory_count",
        )
    )


def forget(memories: DataFrame, users: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Rows kept, per-user deleted counts (0 for unknown users) and audit rows.
    The caller writes ``remaining`` to a new table version, then swaps."""
    forget_ids = users.select(F.col("user_id").cast("string").alias("user_id")).distinct()
    counts = memories.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    deleted = forget_ids.join(counts, "user_id", "left").select(
        "user_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("deleted_memory_count")
    )
    remaining = memories.join(forget_ids, "user_id", "left_anti")
    audit = deleted.select(
        _as_of(memories.sparkSession, as_of).alias("ts"),
        F.lit("user_forgotten").alias("event_type"),
        subject_hash(F.col("user_id")).alias("subject_hash"),
        _json_sorted(("deleted_memory_count", F.col("deleted_memory_count"))).alias("detail"),
    )
    return {"remaining": remaining, "deleted": deleted, "audit": audit}


def rerank(recommendations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add memory interest, rationale and a bounded adjustment (0 when not eligible),
    then rank each user's items by (-adjustment, product)."""
    interest = profiles.select("user_id", F.explode("product_interest_counts").alias("product", "memory_interest_count"))
    joined = recommendations.join(interest, ["user_id", "product"], "left").withColumn(
        "memory_interest_count", F.coalesce("memory_interest_count", F.lit(0)).cast("bigint")
    )
    adj = F.when(F.coalesce(F.col("eligible"), F.lit(True)), F.least(F.col("memory_interest_count"), F.lit(MAX_ADJUSTMENT))).otherwise(0)
    out = joined.select(
        "*",
        F.when(F.col("memory_interest_count") > 0, RATIONALE_PRIOR).otherwise(RATIONALE_NONE).alias("memory_rationale"),
        adj.cast("bigint").alias("memory_rank_adjustment"),
    )
    # rows of one adjustment are numbered together, so no task ranks a whole user
    order = [F.col("memory_rank_adjustment").desc(), F.coalesce(F.col("product"), F.lit("")).asc()]
    return position_within(out, ["user_id"], order, -F.col("memory_rank_adjustment"), out="rank")


def audit_trail(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
