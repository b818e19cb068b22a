"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.llm.staging import stage


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all its v as m. The minimum combines before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the least node.

    Each step stars every neighbourhood on its least node; the number of rounds is logarithmic in
    the component size and no step holds a neighbourhood in one place. Loops, repeated edges and
    edges in both directions are allowed; edges with a null are ignored.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _linked_to_least(large)
        current = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
