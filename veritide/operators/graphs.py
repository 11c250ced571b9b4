"""Reachability in a table of edges, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.scratch import counted


def reachable(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node, depth): every node that is reached from a start, at its least depth; any number of hops if none is given.

    Semi-naive: each level follows the edges (a, b) of the nodes that the level before found
    for the first time, and keeps those that aren't known yet. Levels are written, so a lost
    executor costs one task of one level, and the work is that of one visit for each start
    and node. Nulls, repeated edges and loops add nothing.
    """
    edges = edges.select(F.col("a").alias("node"), F.col("b")).filter("node is not null and b is not null").distinct()
    edges, _ = counted(edges, "reach-edges")
    level, n = counted(starts.filter("node is not null").select(F.col("node").alias("start"), "node").distinct(), "reach-0")
    levels, depth = [level.withColumn("depth", F.lit(0))], 0
    while n and (hops is None or depth < hops):
        depth += 1
        known = reduce(DataFrame.unionAll, (x.select("start", "node") for x in levels))
        step = level.join(edges, "node").select("start", F.col("b").alias("node")).distinct()
        level, n = counted(step.join(known, ["start", "node"], "left_anti"), f"reach-{depth}")
        levels.append(level.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionAll, levels)
