"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.store import stored


def _to_least(edges: DataFrame, large: bool) -> DataFrame:
    """large: hang each node's greater neighbours on the least one it knows; else its smaller ones and itself."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = near.join(least, "u")
    moved = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of each node with an edge (u, v, of one ordered type).

    Rounds of large and small stars run until nothing changes; their number grows with the logarithm of the longest
    chain, and no round holds more rows than there are edges and nodes.
    """
    now, before = stored(edges.where("u <> v").distinct()), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == before or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        now = stored(_to_least(_to_least(now, True), False))
