"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join on the node.

Defined results: links either way, repeated links and links of a node with itself are allowed; a node that is linked with itself alone has no
row; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node, the larger ones or the smaller ones, to its least neighbour or itself."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for each node of ``links`` (u, v), the least node that it is linked with, over any number of links."""
    edges = common.materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges, old = common.materialize(_star(_star(edges, True), False), name), edges
        common.discard(old)
    # every node now points at its least one
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
