"""Streaming twins of the service metrics: sources, sliding summaries, cumulative statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.schemas import schema

RETENTION = "24 hours"
SKETCH = 2048


def read_events(spark: SparkSession, folder: str, kind: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files of one event kind (``perf_events``, ``accuracy_events``, ...)."""
    reader = spark.readStream.schema(schema(kind)).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_kafka_events(spark: SparkSession, servers: str, topic: str, kind: str) -> DataFrame:
    """Stream of JSON events from Kafka (needs the public Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema(kind)).alias("e")).select("e.*")


def _quantile(share: float) -> Column:
    """Value of the sketch ``_sketch`` with this share of its values at or below it; null where it has none."""
    return F.when(F.kll_sketch_get_n_double("_sketch") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(share)))


# A share this little above p picks the zero-based position floor(p * n): the nearest rank, and the upper middle.
# The sketch rounds ranks to seven places, so it must not be smaller; it moves no other rank of up to SKETCH values.
ABOVE = 1e-6


def sliding_performance(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", retention: str = RETENTION) -> DataFrame:
    """Trailing performance summary per window; events older than the retention are dropped.

    All measures are mergeable, so the state is one small row per window and component. Median (mean of the two
    middle values), p95 and p99 (nearest rank) come from a quantile sketch: exact for up to ``SKETCH`` values in a
    window, beyond that within about 0.3 % of the ranks, in at most some 50 kB. Null durations count as requests
    but not in the order statistics.
    """
    return (
        events.withWatermark("ts", retention)
        .groupBy(F.window("ts", window, slide), "component")
        .agg(
            F.count(F.lit(1)).alias("total_requests"), F.avg(F.col("success").cast("double")).alias("success_rate"),
            F.avg((~F.col("success")).cast("double")).alias("error_rate"), F.avg("duration").alias("avg_response_time"),
            F.min("duration").alias("min_response_time"), F.max("duration").alias("max_response_time"),
            F.kll_sketch_agg_double("duration", SKETCH).alias("_sketch"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("ts"), "component", "total_requests",
                "success_rate", "error_rate", "avg_response_time", "min_response_time", "max_response_time",
                ((_quantile(0.5) + _quantile(0.5 + ABOVE)) / 2).alias("median_response_time"),
                _quantile(0.95 + ABOVE).alias("p95_response_time"), _quantile(0.99 + ABOVE).alias("p99_response_time"))
    )


def sliding_accuracy(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes", retention: str = RETENTION) -> DataFrame:
    """Trailing means of confidence and uncertainty per window."""
    return (
        events.withWatermark("ts", retention).groupBy(F.window("ts", window, slide))
        .agg(F.count(F.lit(1)).alias("total_queries"), F.avg("confidence").alias("avg_confidence"), F.avg("uncertainty").alias("avg_uncertainty"))
        .select(F.col("window.end").alias("ts"), "total_queries", "avg_confidence", "avg_uncertainty")
    )


def cumulative_components(events: DataFrame) -> DataFrame:
    """Component statistics over all events so far (update or complete mode); state is one row per component."""
    return events.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum("duration").alias("total_duration"),
        F.sum(F.col("success").cast("bigint")).alias("success_count"), F.sum((~F.col("success")).cast("bigint")).alias("error_count"),
        F.avg("duration").alias("avg_response_time"), F.avg((~F.col("success")).cast("double")).alias("error_rate"))
