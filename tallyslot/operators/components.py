"""Connected components of a large graph, as a DataFrame job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyslot.sources.workdir import materialise


def _toward_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hook the neighbours of every node to the least node among them and itself.

    With ``both_ways`` all neighbours are looked at and the larger ones are
    hooked; without, the smaller ones are looked at and hooked with the node.
    """
    seen = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    if both_ways:
        seen = seen.unionByName(edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = seen.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    # Written first, so that adaptive execution can split a node that has very many neighbours.
    hooked = seen.join(materialise(least, "component-least"), "node")
    if both_ways:
        hooked = hooked.where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        own = least.select(F.col("node").alias("high"), F.col("least").alias("low"))
        hooked = hooked.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(own)
    return hooked.where("high > low").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node that each node of an edge can reach.

    Neighbours are hooked to the least node around, first past every node and
    then below it, until the edges are stars around the least node of each
    component. The number of rounds grows with the square of the logarithm of
    the nodes at most, also for long chains.
    """
    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    ends = materialise(ends, "component-edges")
    mark = None
    while True:
        ends = materialise(_toward_least(_toward_least(ends, True), False), "component-edges")
        row = ends.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    stars = ends.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
