"""Connected components of a graph given by edges, for graphs with hubs.

Alternating large-star and small-star steps (Kiveris et al., 2014).  A step
takes the smallest neighbour of each node, which aggregates before the
shuffle, and joins it back to the edges, where adaptive execution may split a
hub's partition.  Each round is a table in the shared folder, and the one
before it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v; returns edges again, u > v, distinct."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:  # link every larger neighbour to the smallest
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # link every smaller neighbour, and the node itself, to the smallest
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the smallest node reachable."""
    spark = edges.sparkSession
    now, path = common.kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        done = path
        now, path = common.kept(_star(_star(now, True), False), "edges")
        common.drop_written(spark, done)
        before, seen = seen, _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
