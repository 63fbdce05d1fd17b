"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large: each node's larger neighbours go to its smallest; small: its smaller ones."""
    if large:
        edges = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.select(F.col("u").alias("w"), F.least("m", "u").alias("m")), F.col("u") == F.col("w"))
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether each node that points at another points at one only, which points at none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b): component is the smallest node that is reachable.

    Edges with a null end or from a node to itself say nothing; repeated edges count once. Each step is written to the
    shared folder. Both steps keep connectivity and end when every node points at its component's smallest.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _done(now):
        then = stash(_star(_star(now, True), False), "edges")
        discard(now)
        now = then
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
