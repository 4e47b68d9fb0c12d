"""From raw documents to packed training sequences.

Each stage takes the documents its predecessor kept, reread from Parquet, and returns a frame with the
columns of ``documents`` (the last one: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm.common import table, written
from evigraph.llm.mixing import apply_mix
from evigraph.llm.neardup import keep_representatives
from evigraph.llm.packing import pack_documents
from evigraph.llm.quality import keep_good
from evigraph.llm.suffixdup import strip_repeats
from evigraph.session import tune


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that start anywhere else too go from the texts."""
    return strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights."""
    return apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences of 4,096 tokens."""
    return pack_documents(docs, 4096)


STAGES = [
    ("quality_classifier", reject_poor),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Fitting, suffix sorting and tokenising have no SQL form; tests hold the result against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < last:
            docs = written(docs, "stages", f"-{name}")
    return docs
