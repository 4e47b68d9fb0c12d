"""A stored graph that is merged bucket by bucket.

Nodes and edges lie in folders ``bucket=<n>`` by a hash of their keys, an edge by both its ends, so an
entity with any number of edges is spread. A merge rewrites the buckets that incoming edges fall into
and appends nodes that are new; the files of all other buckets stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import graph as gr
from evigraph.session import cut_lineage

BUCKETS = 64
KEYS = {"entities": ["id"], "features": ["id"], "edges": ["entity_id", "feature_id"]}


def _placed(df: DataFrame, part: str, buckets: int) -> DataFrame:
    keys = [F.col(c).cast("string") for c in KEYS[part]]
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, folder: str, mode: str) -> None:
    df.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def create_store(entities: DataFrame, features: DataFrame, edges: DataFrame, path: str, at: Column, buckets: int = BUCKETS) -> None:
    """Write a graph to a new store; ``at`` is the time of its edges."""
    _write(_placed(entities, "entities", buckets), f"{path}/entities", "error")
    _write(_placed(features, "features", buckets), f"{path}/features", "error")
    _write(_placed(edges.withColumn("updated_at", at), "edges", buckets), f"{path}/edges", "error")
    entities.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, features and edges of a store."""
    return tuple(spark.read.parquet(f"{path}/{part}").drop("bucket") for part in KEYS)


def merge_store(spark: SparkSession, path: str, entities: DataFrame, features: DataFrame, edges: DataFrame, at: Column) -> None:
    """Create missing nodes, add or overwrite edges and give these the time ``at``.

    Keys of the incoming rows are unique, as :func:`graph.build_graph` makes them. The new contents of a
    bucket are written beside the store before they replace it; a merge that broke off can be repeated.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    for part, nodes in (("entities", entities), ("features", features)):
        known = spark.read.parquet(f"{path}/{part}").select("id")
        _write(cut_lineage(_placed(nodes, part, buckets).join(known, "id", "left_anti")), f"{path}/{part}", "append")
    incoming = cut_lineage(_placed(edges, "edges", buckets))
    touched = [r.bucket for r in incoming.select("bucket").distinct().collect()]  # at most one number a bucket
    if not touched:
        return
    stored = spark.read.parquet(f"{path}/edges").where(F.col("bucket").isin(touched))
    merged = gr.upsert_edges(stored.drop("bucket"), incoming.drop("bucket"), at)
    _write(cut_lineage(_placed(merged, "edges", buckets)), f"{path}/edges", "overwrite")
