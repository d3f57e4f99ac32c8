"""Stable sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions.

A row's shard depends on its key and the number of shards only; growing from ``n`` to
``n + 1`` shards moves a row only into the new shard, about one row in ``n + 1``. No ring
table exists. The 64-bit linear congruential step is computed on 16/32-bit limbs, since
ANSI arithmetic rejects wrapping products.

Slots number the rows of a shard from 0 without gaps. Rows are dealt to blocks by a hash
of the key; slots are a block's offset (prefix sum over the small table of block counts)
plus the position inside the block, so no window ever spans a whole shard.

Defined cases: a null key is hashed as the empty string (all such rows share a shard; the
crc and size of their texts spread them over blocks); a null text has no bytes (size 1,
crc 0); equal rows get different slots; an empty table gives an empty result; only the
two named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the jump hash: the multiplier's 16-bit limbs, lowest first, and the step.
LCG_MULTIPLIER = 2862933555777941757
LCG_STEP = 1
MASK16 = 0xFFFF
MASK32 = 0xFFFFFFFF


def key_halves(key: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a 64-bit hash (md5 head) of the key's text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def lcg_step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of ``key * LCG_MULTIPLIER + 1`` modulo 2**64; every product stays below 2**49."""
    c0, c1, c2, c3 = ((LCG_MULTIPLIER >> s) & MASK16 for s in (0, 16, 32, 48))
    a = low * c1
    low_sum = low * c0 + F.shiftleft(a.bitwiseAND(MASK16), 16) + LCG_STEP
    high_sum = (
        F.shiftright(low_sum, 32) + F.shiftright(a, 16) + low * c2 + F.shiftleft((low * c3).bitwiseAND(MASK16), 16)
        + high * c0 + F.shiftleft((high * c1).bitwiseAND(MASK16), 16)
    )
    return high_sum.bitwiseAND(MASK32), low_sum.bitwiseAND(MASK32)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of ``key``. The jump loop runs as a fold whose state stops
    changing once the next jump leaves the range; it makes at most ``shards`` jumps."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    high, low = key_halves(key)
    state = F.struct(high.alias("h"), low.alias("l"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        h, low_ = lcg_step(s["h"], s["l"])
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(h.alias("h"), low_.alias("l"), s["j"].alias("b"), to.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump)
    return end["b"].cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rows_per_block: int = 100_000,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard) and slot per row."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("bigint") + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    blocks = max(1, -(-docs.count() // (rows_per_block * shards)))
    rows = rows.select(
        "*",
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).alias("_block"),
    )
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))  # shards * blocks rows
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_at", F.row_number().over(inside)).join(offsets, ["shard", "_block"])
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_offset") + F.col("_at") - 1).cast("bigint").alias("slot")
    )
