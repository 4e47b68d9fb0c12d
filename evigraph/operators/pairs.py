"""Entity tables to (entity, feature) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.session import once


def explode_pairs(
    df: DataFrame,
    id_col: str = "disease_id",
    name_col: str = "disease",
    list_col: str = "common_symptom",
    distinct: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Comma lists to rows ``entity_id, entity, feature``.

    ``distinct=True`` normalises names and features, keeps features longer than one character and
    removes duplicates; ``distinct=False`` only trims and keeps the bag.
    """
    items = df.where(F.col(list_col).isNotNull()).select(
        F.col(id_col).alias("entity_id"),
        F.col(name_col).alias("_name"),
        F.explode(F.split(F.col(list_col), ",")).alias("_item"),
    )
    items = items.withColumn("_item", F.regexp_replace("_item", r"(?U)^\s+|\s+$", "")).where(F.col("_item") != "")
    if not distinct:
        return items.select("entity_id", F.col("_name").alias("entity"), F.col("_item").alias("feature"))
    named = once(items, "feature", tx.normalise_feature(F.col("_item"), strict=strict)).where(F.length("feature") > 1)
    return named.select("entity_id", tx.normalise(F.col("_name")).alias("entity"), "feature").dropDuplicates()


def distinct_counts(pairs: DataFrame) -> DataFrame:
    """Rows, distinct entities and distinct features of a pair table, one row."""
    per_entity = pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    per_feature = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("entities")
    ).withColumn("features", per_feature.agg(F.count(F.lit(1))).scalar())


def last_names(df: DataFrame, id_col: str, name_col: str, seq_col: str) -> DataFrame:
    """One name per id; the last in load order wins."""
    return df.groupBy(id_col).agg(F.max_by(name_col, seq_col).alias(name_col))
