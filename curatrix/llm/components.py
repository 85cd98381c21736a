"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

PART_EDGES = 100_000


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): with m the least of u and its v's, (v, m) for each pair and (u, m)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u").select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b); root is the least node that it reaches.

    Hubs are split by the map-side minimum and by AQE's skew join; no node's neighbours are gathered. There is a partition
    for each PART_EDGES edges at most, so that few of them take few tasks, and no shuffle where they fill one partition only.
    edges are read twice, and should be a stored table.
    """
    parts = 1 + edges.count() // PART_EDGES
    edges = scratch.save(edges.coalesce(parts).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(parts)
        large = _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").coalesce(parts).distinct()
        after = scratch.save(small)
        scratch.drop(edges)
        edges = after
        # Done once this is a forest of stars: every node has one edge, and no centre has one.
        sides = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("centre")).distinct()).coalesce(parts)
        if not sides.groupBy("a").agg(F.sum("n").alias("n"), F.max("centre").alias("centre")).where("n > 1 or (n > 0 and centre = 1)").limit(1).count():
            break
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).coalesce(parts).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(centres).coalesce(parts)
