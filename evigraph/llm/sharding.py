"""Sharding by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ordered import spread_row_number
from evigraph.llm.common import text_key, written

# Sizes up to 2 ** HEAD_BITS have a class of their own; larger ones share one with sizes that agree in
# their leading HEAD_BITS bits (0.1 %). So there are at most 2 ** 10 * 54 classes, whatever the data.
HEAD_BITS = 11
BUCKETS = 1024


def schedule(classes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """Longest processing time first: how many groups of each class every shard gets.

    ``classes``: (groups, bytes) from the largest group size down. Each group goes to the shard with
    the smallest load; a class of many groups is dealt up to a common level first, which is where the
    heap would put them, and only its last few groups go through the heap one by one.
    """
    loads = [0.0] * shards
    dealt = []
    for groups, size in classes:
        each = size / groups
        given = [0] * shards
        rest = groups
        if rest > 4 * shards:
            low, high = min(loads), max(loads) + size
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, int((level - x) // each)) for x in loads) <= groups:
                    low = level
                else:
                    high = level
            given = [max(0, int((low - x) // each)) for x in loads]
            rest -= sum(given)
            loads = [x + n * each for x, n in zip(loads, given, strict=True)]
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(rest):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + each, i))
            given[i] += 1
            loads[i] = x + each
        dealt.append(given)
    return dealt


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of nearly equal bytes; equal texts stay in one shard.

    Result: ``doc_id, size`` (UTF-8 bytes and 1), ``text_crc32, shard, slot`` (0, 1, ... in the shard).
    A null text counts as an empty one and is in its group. A group larger than a shard's part fills
    one shard above the others, which the law of staying together demands. Rows with equal ``doc_id``
    are separate documents. Other columns are ignored; an empty table gives no rows.

    Groups are counted, classed by size and only the class table (bounded, see ``HEAD_BITS``) reaches
    the driver, where the heap runs. A group finds its shard by its rank in the class, which is
    computed in two levels, as are the slots: no class, group or shard is ever in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *text_key("text"))
    )
    key = ["k1", "k2", "size"]
    sized = base.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("bytes"))
    groups = written(
        sized.withColumn("shift", F.greatest(F.length(F.bin("bytes")) - HEAD_BITS, F.lit(0))).withColumn("head", F.expr("shiftright(bytes, shift)"))
    )
    classes = groups.groupBy("shift", "head").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()
    classes.sort(key=lambda r: (-r.shift, -r.head))
    dealt = schedule([(r.n, r.b) for r in classes], shards)
    rows = []
    for r, given in zip(classes, dealt, strict=True):
        ends, end = [], 0
        for n in given:
            ends.append(end := end + n)
        rows.append((r.shift, r.head, ends))
    plan = spark.createDataFrame(rows, "shift int, head bigint, ends array<bigint>")
    ranked = spread_row_number(groups, ["shift", "head"], F.pmod("k1", F.lit(BUCKETS)), key, "rank")
    placed = ranked.join(F.broadcast(plan), ["shift", "head"]).select(
        *key, F.expr("size(filter(ends, e -> e < rank))").alias("shard")
    )
    dealt_docs = base.join(placed, key).withColumn("spot", F.xxhash64("doc_id", "k1"))
    slots = spread_row_number(dealt_docs, ["shard"], F.pmod("spot", F.lit(BUCKETS)), ["spot", "doc_id", "k1", "k2"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
