"""Connected components of a link table by alternating large and small stars.

Every round rewrites the links with one aggregate (smallest neighbour) and one join, writes
them to the shared folder and stops when a checksum of the links no longer changes. Only
row counts and checksums reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links of every vertex's neighbours to the smallest vertex of its star: in a small star
    the neighbours below the vertex, in a large star those above it."""
    pairs = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    if not small:
        pairs = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
    low = pairs.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    joined = pairs.join(low, "v")
    if small:
        out = joined.select(F.col("u").alias("b"), F.col("m").alias("a")).unionByName(low.select(F.col("v").alias("b"), F.col("m").alias("a")))
    else:
        out = joined.where("u > v").select(F.col("u").alias("b"), F.col("m").alias("a"))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (a, b); component is its smallest vertex."""
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        links = cut_lineage(_star(_star(links, small=False), small=True))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
