"""Weighted random walks on the bipartite graph and node embeddings from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.numeric import hash60, uniform
from evigraph.functions.ordered import spread_running
from evigraph.session import cut_lineage

BUCKETS = 64


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of ``entity_id, feature_id, weight`` as ``src, dst, weight`` with typed node names."""
    e = edges.select(F.concat(F.lit("d::"), F.col("entity_id").cast("string")).alias("src"),
                     F.concat(F.lit("s::"), F.col("feature_id")).alias("dst"), "weight").where(F.col("weight") > 0)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def transition_index(adj: DataFrame) -> DataFrame:
    """Rows ``src, cell, dst, low, high``: each edge's share of [0, 1), filed under every cell it meets.

    A node has as many equal cells as neighbours, so a uniform draw meets a couple of rows by an
    equi-join on (node, cell), even at a node that holds a third of all edges. The running shares
    are summed in two levels and never put one node into one task.
    """
    total = adj.groupBy("src").agg(F.sum("weight").alias("_t"), F.count(F.lit(1)).alias("cells"))
    shares = adj.join(total, "src").withColumn("_share", F.col("weight") / F.col("_t"))
    placed = spread_running(shares, ["src"], F.pmod(hash60(F.col("dst")), F.lit(BUCKETS)), ["dst"], F.col("_share"), "high")
    placed = placed.withColumn("low", F.col("high") - F.col("_share"))
    first = F.floor(F.greatest(F.col("low"), F.lit(0.0)) * F.col("cells"))
    last = F.least(F.floor(F.col("high") * F.col("cells")), F.col("cells") - 1)
    return placed.select("src", "cells", F.explode(F.sequence(F.least(first, last), last)).alias("cell"), "dst", "low", "high")


def random_walks(edges: DataFrame, num_walks: int = 80, length: int = 20, seed: int = 42) -> DataFrame:
    """Walks ``start, walk, path``: one join per step.

    A step carries only where each walk is; every step is written, and the paths are put together once
    at the end. Rounding may leave slivers of the unit interval uncovered; a draw there takes the
    node's last edge, so no walk is lost.
    """
    adj = adjacency(edges)
    index = cut_lineage(transition_index(adj))
    top = index.groupBy("src").agg(F.max_by("dst", F.struct("high", "dst")).alias("_last"), F.max("cells").alias("cells"))
    top = cut_lineage(top.withColumnRenamed("src", "node"))
    cells = index.select(F.col("src").alias("node"), "cell", "dst", "low", "high")
    nodes = adj.select("src").distinct()
    now = nodes.select(F.col("src").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"), F.col("src").alias("node"))
    steps = [now.withColumn("step", F.lit(0))]
    for step in range(1, length):
        drawn = now.join(top, "node").withColumn(
            "_u", uniform(F.lit(seed), F.col("start"), F.col("walk"), F.lit(step))
        ).withColumn("cell", F.least(F.floor(F.col("_u") * F.col("cells")), F.col("cells") - 1)).drop("cells")
        hit = drawn.join(cells, ["node", "cell"], "left")
        inside = (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))
        now = cut_lineage(
            hit.groupBy("start", "walk").agg(F.coalesce(F.max(F.when(inside, F.col("dst"))), F.max("_last")).alias("node"))
        )
        steps.append(now.withColumn("step", F.lit(step)))
    every = reduce(lambda a, b: a.unionByName(b), steps)
    # a walk has ``length`` steps
    path = F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"])
    return every.groupBy("start", "walk").agg(path.alias("path"))


def node_embeddings(walks: DataFrame, dim: int = 96, window: int = 5, seed: int = 42) -> DataFrame:
    """Vectors ``kind, node, embedding`` of the nodes on the walks, split by node kind; see
    :func:`projected_embeddings`, which is the one method at every size."""
    vectors = projected_embeddings(walks, dim, window, seed)
    parts = F.split("_n", "::", 2)
    return vectors.select(F.when(F.get(parts, 0) == "d", "entity").otherwise("feature").alias("kind"), F.get(parts, 1).alias("node"), "embedding")


def projected_embeddings(walks: DataFrame, dim: int, window: int, seed: int = 42) -> DataFrame:
    """Random projection of the positive PMI of window co-occurrences; joins and sums only.

    Skip-gram factorises a shifted PMI matrix; projecting that matrix keeps its inner products in
    expectation and needs no model on the driver.
    """
    steps = walks.select(F.posexplode("path").alias("i", "_n"), "path")
    near = steps.select("_n", F.explode(F.slice("path", F.greatest(F.col("i") - window + 1, F.lit(1)), F.lit(2 * window + 1))).alias("ctx"))
    counts = cut_lineage(near.where(F.col("_n") != F.col("ctx")).groupBy("_n", "ctx").agg(F.count(F.lit(1)).alias("c")))
    row, col = counts.groupBy("_n").agg(F.sum("c").alias("r")), counts.groupBy("ctx").agg(F.sum("c").alias("k"))
    # a context's signs are drawn once, as bits, and not for each of its neighbours
    draw = lambda d: F.shiftleft(F.pmod(hash60(F.lit(seed), F.lit(d), F.col("ctx")), F.lit(2)), d % 60)
    col = cut_lineage(col.select("*", *[
        reduce(lambda a, b: a.bitwiseOR(b), [draw(d) for d in range(at, min(at + 60, dim))]).alias(f"b{at // 60}") for at in range(0, dim, 60)]))
    total = counts.agg(F.sum("c")).scalar()
    ppmi = counts.join(row, "_n").join(col, "ctx").withColumn("w", F.greatest(F.lit(0.0), F.log(F.col("c") * total / (F.col("r") * F.col("k")))))
    sign = lambda d: F.shiftright(f"b{d // 60}", d % 60).bitwiseAND(F.lit(1)) * 2 - 1
    signs = [(F.sum(F.col("w") * sign(d)) / dim ** 0.5).alias(f"v{d}") for d in range(dim)]
    summed = ppmi.groupBy("_n").agg(*signs)
    return summed.select("_n", F.array(*[f"v{d}" for d in range(dim)]).alias("embedding"))
