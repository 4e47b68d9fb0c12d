"""Streaming ingestion of documents into collections, and recording of job durations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evigraph.operators import chunking as ck
from evigraph.operators import documents as dm
from evigraph.schemas import schema


def chunk_stream(docs: DataFrame, size: int = ck.CHUNK_SIZE, overlap: int = ck.CHUNK_OVERLAP) -> DataFrame:
    """Documents ``source_file, text`` to stored chunk rows; row-local, so it streams as it runs in batch."""
    described = dm.document_metadata(docs).withColumn(
        "_m", dm.string_metadata({c: F.col(c) for c in ("document_type", "patient_id", "date", "source_file")}))
    return dm.collection_rows(ck.chunk_rows(described, ck.document_chunks(F.col("text"), size, overlap), "source_file", "_m"))


def ingest(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a document stream to the collection store; the checkpoint makes restarts exact."""
    writer = chunk_stream(docs).writeStream.format("parquet").partitionBy("collection").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


@contextmanager
def timed(spark: SparkSession, path: str, component: str, operation: str) -> Iterator[dict]:
    """Run a block and append one performance event with its duration and outcome."""
    meta: dict = {}
    begun, ok = time.time(), True
    try:
        yield meta
    except Exception as exc:
        ok = False
        meta["error"] = type(exc).__name__
        raise
    finally:
        row = spark.range(1).select(
            F.timestamp_seconds(F.lit(begun)).alias("ts"), F.lit(component).alias("component"), F.lit(operation).alias("operation"),
            F.lit(time.time() - begun).alias("duration"), F.lit(ok).alias("success"),
            (F.create_map(*[F.lit(str(x)) for kv in meta.items() for x in kv]) if meta else F.create_map()).cast("map<string,string>").alias("metadata"))
        row.select(*schema("perf_events").names).write.mode("append").parquet(path)
