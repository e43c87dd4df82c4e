"""Connected components by alternating large-star and small-star steps on an edge table.

Ends of edges are never null; repeated edges, loops and an empty table are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.scratch import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Tie the neighbours v of each u to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    tied = pairs.join(least, "u").where(keep)
    return tied.select(F.col("v").alias("a"), F.col("low").alias("b"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges (a, b) of longs -> node, root (the least node of its component); only nodes with an edge to another.

    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        large = _star(_both_ways(now), "v > u").where("a <> b").distinct()
        # small star: each node and its lesser neighbours go to the least of these
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("low").alias("b")), F.struct(F.col("u").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
