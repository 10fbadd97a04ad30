"""Connected components of a graph of pairs, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellumflow.sources.tables import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (its smallest id) of every node of edges (a, b).

    Large-star and small-star steps in turn until nothing changes; each round's edges are checkpointed, so lost executors
    cost one round. Rows of a node with many neighbours are split by adaptive skew joins. Rounds grow with the logarithm of the longest path. Loops and repeated edges don't matter; no edges give
    no rows.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before: tuple | None = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        # equal sets of edges have equal counts and sums of hashes, which a pass over each gives without a shuffle
        seen = Observation()
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        after = checkpointed(small.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("h")))
        state = (seen.get["n"], seen.get["h"])
        if state == before:
            break
        now, before = after, state
    else:
        raise RuntimeError("the components did not settle")
    heads = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads).distinct()
