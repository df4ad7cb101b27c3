"""Connected components of an edge table, by alternating large-star and small-star steps in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import release, staged


def _least_of_neighbours(edges: DataFrame) -> DataFrame:
    """edges u, v -> u, m: the least of u and its neighbours. Partial aggregation keeps hubs cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:  # larger neighbours of u go to the least of its neighbourhood
        moved = both.join(_least_of_neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours of u, and u itself, go to the least of them
        down = both.where("v < u")
        moved = down.join(_least_of_neighbours(down), "u")
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether no node has an edge to more than one smaller node, or to one and from a larger one: each component is then a star around its least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.count("*").alias("n")).where("out > 1 or (out = 1 and n > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges u, v (long; loops and repeats allowed) -> node, root: the least node that node reaches. Nodes without an edge to another one are left out. Null ends are ignored.

    The number of rounds grows with the logarithm of the number of nodes; every round is a written table.
    """
    edges = staged(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _done(edges):
        before, edges = edges, staged(_step(_step(edges, large=True), large=False))
        release(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
