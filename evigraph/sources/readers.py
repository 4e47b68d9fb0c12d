"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions.ordered import top_per_group
from evigraph.schemas import schema


def read_disease_table(spark: SparkSession, path: str) -> DataFrame:
    """Disease table from CSV with a header."""
    return spark.read.schema(schema("diseases")).option("header", True).option("escape", '"').csv(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weight table from Parquet or CSV; absent weight columns are filled from the frequency weight or 0.5."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        # the columns of a CSV are known by its header only; the values are cast below, not inferred
        df = spark.read.option("header", True).option("escape", '"').csv(path)
    number = lambda c: F.col(c).try_cast("double")
    if "frequency_weight" not in df.columns and "weight" in df.columns:
        df = df.withColumn("frequency_weight", number("weight"))
    base = number("frequency_weight") if "frequency_weight" in df.columns else F.lit(0.5)
    for c in ("frequency_weight", "tfidf_weight", "pmi_weight"):
        df = df.withColumn(c, number(c) if c in df.columns else base)
    key = F.trim(F.lower("symptom"))
    return df.withColumn("symptom_key", key).withColumn("symptom_id", tx.slug_id(key))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Annotated corpus, one JSON object per line."""
    return spark.read.schema(schema("annotated")).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Linked predictions, one JSON object per line."""
    return spark.read.schema(schema("predictions")).json(path)


def read_conversation_records(spark: SparkSession, path: str) -> DataFrame:
    """Conversation records as rows ``conv_id, turn, role, text``.

    Ids are hashes of the record and of its number among equal records, so equal records stay apart.
    """
    records = spark.read.schema(schema("conversation_records")).json(path).where(F.col("messages").isNotNull())
    counted = records.groupBy(F.to_json("messages").alias("record")).agg(F.count(F.lit(1)).alias("n"), F.first("messages").alias("messages"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return numbered.withColumn("conv_id", F.xxhash64("record", "copy")).select(
        "conv_id", F.posexplode("messages").alias("turn", "m")
    ).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def read_kb_names(entities: DataFrame, features: DataFrame) -> DataFrame:
    """Dictionary of a stored graph: both node tables with lower-case names, entities first."""
    shape = lambda df, kind, first: df.where(F.coalesce("name", F.lit("")) != "").select(
        F.col("id").cast("string").alias("concept_id"), F.lower("name").alias("name"),
        F.coalesce("display_name", "name").alias("display_name"), F.lit(kind).alias("concept_type"), F.lit(first).cast("bigint").alias("load_seq"))
    return shape(entities, "DISEASE", 0).unionByName(shape(features, "SYMPTOM", 1))


def read_messages(spark: SparkSession, path: str, conv_id: str | None = None, last: int | None = None) -> DataFrame:
    """Stored messages, optionally of one conversation, in order; ``last`` keeps the latest n of each."""
    df = spark.read.schema(schema("messages")).parquet(path)
    if conv_id is not None:
        df = df.where(F.col("conv_id") == conv_id)
    bot_second = F.col("sender") == "bot"
    if last is not None:
        df = top_per_group(df, ["conv_id"], [F.desc("ts"), bot_second.desc()], last).drop("rank")
    return df.orderBy("conv_id", "ts", bot_second)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored entities, features and edges."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("entities", "features", "edges"))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks, partitioned by collection, so a filter on it prunes files."""
    return spark.read.parquet(path)
