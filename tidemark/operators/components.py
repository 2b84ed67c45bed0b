"""Connected components by alternating large-star and small-star rounds; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for all nodes of ``edges`` (a, b).

    Each round is written to the shared scratch folder. It ends when the sum over the edges no longer changes and every
    edge points to a smallest node; the rounds needed grow with the logarithm of the longest path."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    last = None
    for _ in range(most_rounds):
        # Large star: neighbours above a node move to the least of its neighbourhood.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its lower neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        before, e = e, materialize(small, "edges")
        release(before)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
