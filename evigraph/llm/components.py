"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import scalars, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node with the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every node of ``edges`` (``u, v`` long).

    Loops, repeated edges and both directions may occur; null ends are ignored. Only joins and grouped
    minima are used, so a node with any number of edges is split like any hot join key; the driver
    sees a count and a checksum a round.
    """
    current = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    mark = None
    while True:
        current = written(_small_star(_large_star(current)).distinct())
        now = scalars(current, F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == mark:
            break
        mark = now
    # every node but the smallest points to the smallest
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
