"""Writers. Tables that are read and replaced go to a new folder first, so a failed job loses nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import graph as gr
from evigraph.operators.conversation import new_messages
from evigraph.sources.readers import read_collections, read_graph


def write_table(df: DataFrame, path: str, formats: Sequence[str] = ("parquet",)) -> None:
    """One table in one or several formats; several formats go to ``path/<format>``."""
    for fmt in formats:
        target = path if len(formats) == 1 else f"{path}/{fmt}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).option("escape", '"').csv(target)
        elif fmt == "json":
            writer.json(target)
        else:
            writer.parquet(target)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Corpus as CSV and as JSON lines."""
    write_table(corpus, path, ("csv", "json"))


def write_split(df: DataFrame, path: str, part_col: str = "part") -> None:
    """JSON lines of every part of a split in one pass, a folder per part."""
    df.write.mode("overwrite").partitionBy(part_col).json(path)


def write_statistics(one_row: DataFrame, path: str) -> None:
    """A one-row frame as a single JSON object."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def write_graph(entities: DataFrame, features: DataFrame, edges: DataFrame, path: str) -> None:
    """Rebuild the stored graph from empty. Edges are sorted by feature within files for pruning."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    features.write.mode("overwrite").parquet(f"{path}/features")
    edges.sortWithinPartitions("feature_id").write.mode("overwrite").parquet(f"{path}/edges")


def upsert_graph(spark: SparkSession, stored: str, entities: DataFrame, features: DataFrame, edges: DataFrame, target: str) -> None:
    """Merge nodes and edges into a stored graph and write the result to ``target``."""
    if stored.rstrip("/") == target.rstrip("/"):
        raise ValueError("a graph cannot be replaced while it is being read; give another target")
    old_entities, old_features, old_edges = read_graph(spark, stored)
    write_graph(gr.upsert_nodes(old_entities, entities), gr.upsert_nodes(old_features, features),
                gr.upsert_edges(old_edges, edges), target)


def add_to_collections(rows: DataFrame, path: str) -> None:
    """Append chunk rows ``text, id, metadata, collection`` to their collections."""
    rows.write.mode("append").partitionBy("collection").parquet(path)


def drop_collections(spark: SparkSession, path: str, target: str, names: Sequence[str] | None = None) -> None:
    """Rewrite the store without the named collections (without any of them when None)."""
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("a store cannot be replaced while it is being read; give another target")
    kept = read_collections(spark, path)
    kept = kept.where(F.lit(False)) if names is None else kept.where(~F.col("collection").isin(list(names)))
    kept.write.mode("overwrite").partitionBy("collection").parquet(target)


def save_exchange(messages: DataFrame, exchanges: DataFrame, path: str) -> None:
    """Append the user and bot messages of new exchanges to the stored messages."""
    new_messages(messages, exchanges).write.mode("append").parquet(path)
