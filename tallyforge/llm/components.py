"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node that it reaches.

    Alternates two steps on the links until they stay as they are: each node's larger neighbours move to its smallest
    neighbour ("large"), then its smaller neighbours do ("small"). What remains are stars around the smallest node.
    Aggregates and joins alone; a hub's links are never gathered in one row. Self-links and repeats do no harm.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = ws.write(now, "graph")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both joins read written tables, so that Spark can split the links of a hub (a skewed join) over tasks.
        least = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = ws.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u")
        small = moved.select("u", F.col("m").alias("v")).unionByName(moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = ws.write(small, "graph")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(now, least, large, low)
        now = after
        if tuple(mark) == before:
            break
        before = tuple(mark)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ws.write(stars.unionByName(stars.select("component", "component").distinct().toDF("node", "component")), "components")
