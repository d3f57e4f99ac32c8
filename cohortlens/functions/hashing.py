"""Seeded, engine-portable hashing of keys.

``md5(seed || ':' || key)`` renders the same hex text in every SQL engine, so a split
or sample defined on it is reproducible outside Spark and needs no shuffle: each row
decides its bucket on its own.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def seeded_hex(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_unit(seed: int, key: Column) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of the seeded md5."""
    head = F.conv(F.substring(seeded_hex(seed, key), 1, 8), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(TWO_POW_32)
