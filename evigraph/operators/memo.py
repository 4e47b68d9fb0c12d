"""Reuse of stored results: compute only inputs whose result is not in the store.

Store rows: ``component, key_hash, input, result, stored_at, hits``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions.numeric import ratio
from evigraph.session import cut_lineage


def keyed(inputs: DataFrame, component: str | Column, input_col: str = "input") -> DataFrame:
    return inputs.withColumn("key_hash", tx.result_key(component, F.col(input_col)))


def fresh(store: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Rows that have not expired; also the purge of the others when written back."""
    return store.where(F.col("stored_at") >= as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def missing_inputs(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct keys without a stored result."""
    return requests.groupBy("key_hash").agg(F.min("input").alias("input")).join(store.select("key_hash"), "key_hash", "left_anti")


def reuse(
    requests: DataFrame, store: DataFrame, component: str, compute: Callable[[DataFrame], DataFrame], as_of: Column,
    ttl_seconds: int = 3600, max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results for all requests and the updated store.

    ``compute`` maps ``key_hash, input`` to ``key_hash, result``; each distinct missing input is
    computed once. Results over ``max_bytes`` are returned but not stored.
    """
    asked = keyed(requests, component)
    valid = fresh(store.where(F.col("component") == component), as_of, ttl_seconds)
    # written once: both results read the table, so the function runs once per missing input
    new = cut_lineage(compute(missing_inputs(asked, valid)).select("key_hash", "result"))
    results = valid.select("key_hash", "result", F.lit(True).alias("hit")).unionByName(new.withColumn("hit", F.lit(False)))
    answered = asked.join(results, "key_hash", "left")
    uses = asked.groupBy("key_hash").agg(F.count(F.lit(1)).alias("_u"), F.min("input").alias("_i"))
    kept = valid.join(uses, "key_hash", "left").select(
        "component", "key_hash", "input", "result", "stored_at", (F.col("hits") + F.coalesce("_u", F.lit(0))).alias("hits"))
    small = new if max_bytes is None else new.where(F.octet_length("result") <= max_bytes)
    added = small.join(uses, "key_hash").select(
        F.lit(component).alias("component"), "key_hash", F.col("_i").alias("input"), "result", as_of.alias("stored_at"),
        F.lit(0).cast("bigint").alias("hits"))
    others = store.where(F.col("component") != component)
    return answered, others.unionByName(kept).unionByName(added)


def invalidate(store: DataFrame, component: str | None = None, pattern: str | None = None) -> DataFrame:
    """Store without the rows of a component or of a SQL LIKE pattern on the key; empty without either."""
    if pattern is not None:
        return store.where(~F.col("key_hash").like(pattern))
    if component is not None:
        return store.where(F.col("component") != component)
    return store.where(F.lit(False))


def reuse_statistics(answered: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a batch of requests."""
    return answered.agg(
        F.sum(F.col("hit").cast("bigint")).alias("hits"), F.sum((~F.col("hit")).cast("bigint")).alias("misses"),
        F.count(F.lit(1)).alias("total_requests"),
    ).withColumn("hit_rate", ratio(F.col("hits"), F.col("total_requests")))
