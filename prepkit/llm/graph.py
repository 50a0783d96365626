"""Connected components by alternating large and small stars, as joins of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: neighbours are tied to the least one instead of to u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.where("u <> v").distinct(), "star")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one."""
    sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = sides.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return nodes.where("child > 1 OR (child = 1 AND parent = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the least node of its component."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        now = _starred(_starred(now, True), False)
        if _is_forest_of_stars(now):
            break
    own = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return written(own.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
