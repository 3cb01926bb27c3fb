"""Connected components of a graph given as edges, by alternating large and small stars.

Each step turns the neighbourhood of a vertex into a star around its smallest member.  A
step is one aggregation and one join, both over written tables, so a vertex with very many
neighbours is pre-aggregated in the map tasks and its partition of the join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (or the smaller) neighbours of each vertex to its minimum."""
    around = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    linked = written(around, "star-around").join(written(lowest, "star-lowest"), "a")
    if large:
        made = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        made = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(linked.select("a", F.col("low").alias("b")))
    return made.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges(a, b)``; component is its smallest vertex.

    The sum and number of the edges tell whether a step changed anything.
    """
    now = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    state = None
    while True:
        now = written(_star(now, large=True), "star-large")
        now = written(_star(now, large=False), "star-small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
