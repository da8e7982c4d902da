"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) -> (id, component), a table in `scratch`: each id that occurs, with the smallest id it can reach.

    Every step sends an edge to the smallest neighbour of one of its ends, found by an aggregate that combines on the
    map side and joined back, so a node with many edges is never gathered. Each round is a table too; rounds go on
    until every component is a star, which takes about the logarithm of the longest path."""
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, edges = edges, scratch.save(small.where("u <> v").distinct())
        scratch.drop(last)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = scratch.save(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    scratch.drop(edges)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and is no lower end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)").isEmpty()
