"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._io import materialise


def _stars(both: DataFrame, keep_larger: bool) -> DataFrame:
    """Links each neighbour (those larger than the node, or smaller ones and the node) to the least of the node and its neighbours."""
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")).withColumnRenamed("a", "n")
    joined = both.join(least, F.col("a") == F.col("n"))
    if keep_larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return ends.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node that has an edge to another one.

    `edges`: a, b of a type with an order, nulls none. Large and small stars alternate until nothing changes; each round is written
    to the shared folder, aggregates before it shuffles, and no component is ever gathered in a task.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    mark = None
    while True:
        current = materialise(current)
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == found or not found[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
        mark = found
        both = current.union(current.select("b", "a"))
        large = _stars(both, True).distinct()
        current = _stars(large, False).distinct()
