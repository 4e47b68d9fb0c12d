"""The given tables and the views on them that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import tune, widen


TEXT_TABLES = {"documents", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; text tables stored in very few row groups are spread over the cores first."""
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df) if name in TEXT_TABLES else df


def pair_bag(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Customers as entities and the names of the parts they ordered as features, as a bag.

    With ``before`` a column ``early`` tells whether a row's order key has an order before that day, else it is null.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    marks = []
    if before is not None:
        first = orders.where(F.col("o_orderdate") < before).select("o_orderkey").distinct()
        orders = orders.where(F.col("o_orderkey").isNotNull()).join(first.withColumn("early", F.lit(True)), "o_orderkey", "left")
        marks = ["early"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        lines.join(orders.drop("o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("entity_id"), F.col("p_name").alias("feature"), *marks)
    )


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.lower("c_name").alias("entity")
    )


def rnd(c, places: int = 6) -> Column:
    """Rounded value for comparison; the tiny shift settles exact halves the same way everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), places)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, places) for c in cols})
