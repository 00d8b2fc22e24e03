"""Connected groups of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.sources.shared import settle


def connected(edges: DataFrame) -> DataFrame:
    """``node, group`` of all nodes of ``edges(u, v)`` of longs; nodes have one group if a path joins them.

    Each round every node goes to its smallest neighbour's smallest neighbour, edges move with their ends, and those that
    became loops go. With random numbers as nodes (hashes, say) a round takes away a constant share of them, whatever the
    shape of the graph. Edges with a null end are left out; an empty table gives an empty one.
    """
    e = settle(edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct())
    told = settle(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().select("node", F.col("node").alias("group")))
    e = e.where("u <> v")
    while not e.isEmpty():
        both = e.union(e.select("v", "u"))
        to = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")))
        to = settle(to.join(to.select(F.col("u").alias("to"), F.col("to").alias("on")), "to").select("u", F.col("on").alias("to")))
        told = settle(told.join(to.select(F.col("u").alias("group"), "to"), "group", "left").select("node", F.coalesce("to", "group").alias("group")))
        moved = e.join(to, "u").select(F.col("to").alias("a"), "v").join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        e = settle(moved.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    return told
