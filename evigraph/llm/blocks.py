"""Vectors packed in blocks, and pairs of blocks as rows of an equi-join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow

BLOCK = 4096


def usable(vector: str) -> Column:
    """Whether a vector is there, has components and all of them are finite numbers."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def block_numbers(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Block of each row of ``tid, dim``: rows are hashed to blocks of about ``block`` rows of one dimension."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("tid"), "blocks").cast("int"))


def pack_blocks(rows: DataFrame, columns: list[str], vector: str, kind: str, parts: int) -> DataFrame:
    """One row per (dim, block): the named long columns as arrays and the vectors as a matrix of ``kind``.

    ``rows`` has ``dim, block``, the columns and the vector.
    """
    keys = ["dim", "block"]

    def pack(batches):
        held, last = [], None

        def row():
            table = pa.Table.from_batches(held)
            matrix = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            values = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in columns]
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), *values, pa.array([matrix.tobytes()], pa.binary())],
                [*keys, *columns, "matrix"],
            )

        for batch in batches:
            tags = list(zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist(), strict=True))
            begin = 0
            for i, tag in enumerate(tags):
                if tag != last:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    if held:
                        yield row()
                    held, begin, last = [], i, tag
            if len(tags) > begin:
                held.append(batch.slice(begin))
        if held:
            yield row()

    schema = "dim int, block int, " + "".join(f"{c} array<long>, " for c in columns) + "matrix binary"
    ordered = rows.select(*keys, *columns, vector).repartition(parts, *keys).sortWithinPartitions(*keys)
    return map_arrow(ordered, pack, schema)


def matrix_of(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, dim)
