"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings that the plans rely on. Only SQL confs, so they can be applied to a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts go to the Python workers in small batches: what a worker makes of them is several times as large
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

# Frees the shuffle files of a written table as soon as it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session, once, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_evigraph_shipped", False):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="evigraph-package-")  # Spark serves the archive from here to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "evigraph_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._evigraph_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    ship(spark)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("evigraph")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one the session names, else a temporary one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = os.path.join(tempfile.mkdtemp(prefix="evigraph-"), "checkpoints")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written table.

    A lost executor re-reads it instead of replaying the plan behind it; as Parquet it is pruned by
    column and has a known size for the choice of joins. The shuffle files behind it go when it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition to the session's shuffle width ahead of work that is heavy per input byte.

    Adaptive execution merges partitions by their bytes, which would leave few tasks for rows that
    multiply or cost much time each; a stated number of partitions is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than there are cores; a wide one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a costly column so that it is computed a single time per row.

    A filter on a plain projected column is pushed below the projection and repeats the expression
    there; the one-item explode keeps it where it is, inside the same stage.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))
