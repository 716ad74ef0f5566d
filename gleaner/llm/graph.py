"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does; two numbers are all that reaches the driver."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, root), root the smallest node reachable; nodes without a link are absent.

    Each round is two grouped minima and two joins with them. The minima are combined
    before the shuffle and the joins are ordinary equi-joins, so that a node with very
    many neighbours is split by adaptive execution. Every round ends in a written table.
    """
    now = edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big <> small").distinct()
    now = materialise(now, "edges")
    before = _mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        # Large star: every larger neighbour of a node moves to the least of node and neighbours.
        least = now.groupBy(F.col("small").alias("node")).agg(F.min("small").alias("m"))
        down = now.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("m"))
        least = least.unionByName(down).groupBy("node").agg(F.min("m").alias("m"))
        large = now.join(least, now.small == least.node).select("big", F.col("m").alias("small")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("m"))
        both = large.join(least, large.big == least.node)
        moved = both.select(F.explode(F.array(F.struct(F.col("small").alias("big"), F.col("m").alias("small")), F.struct(F.col("big").alias("big"), F.col("m").alias("small")))).alias("e"))
        now = materialise(moved.select("e.big", "e.small").where("big <> small").distinct(), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("big").alias("node"), F.col("small").alias("root"))
