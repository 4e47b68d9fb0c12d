"""Reading tables and cutting lineage for the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import CLEANUP, checkpoint_dir, tune

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
RECORDS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, folder: str = "tables", name: str = "") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the table.

    A lost executor re-reads the table instead of replaying the plan behind it. While it is written,
    batches for Python workers are small; the session's own settings are put back after it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{folder}/{uuid.uuid4().hex}{name}"
    settings = {CLEANUP: "true", BATCH: str(RECORDS)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's shuffle width, for work whose cost does not follow its bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_key(text: str | Column) -> list[Column]:
    """Columns ``k1``, ``k2`` (long): 128 bits that stand for a text; null counts as the empty text."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [
        F.xxhash64(whole).alias("k1"),
        F.xxhash64(F.lit("second"), whole).alias("k2"),
    ]


def scalars(df: DataFrame, *aggregates: Column) -> Sequence:
    """One row of totals; its size does not depend on the data."""
    return df.agg(*aggregates).first()


def map_arrow(df: DataFrame, function, schema: str, records: int = RECORDS) -> DataFrame:
    """``mapInArrow`` whose ``function`` sees batches of at most ``records`` rows.

    Spark's own batches (limited in rows and bytes by the session, whose settings stay as they are)
    are copied in parts, so a frame may run at any time after it was made.
    """

    def bounded(batches):
        def parts():
            for batch in batches:
                if batch.num_rows <= records:
                    yield batch
                    continue
                for begin in range(0, batch.num_rows, records):
                    # a copy, as some kernels misread arrays that begin inside a buffer
                    yield batch.take(pa.array(range(begin, min(begin + records, batch.num_rows))))

        yield from function(parts())
        # a worker lives on after its task; what that no longer needs goes back to the system
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)
