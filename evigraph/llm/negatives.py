"""Hard negatives by Strassen products of integer tiles and mergeable heaps."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.blocks import block_numbers, matrix_of, pack_blocks, usable
from evigraph.llm.common import map_arrow, width, written

SCALE = 256
# Anchors that a task holds while candidate blocks pass, and anchors multiplied at a time.
ANCHOR_BLOCK = 4096
STRIP = 512
# Products with a side of at most this many rows or columns are multiplied plainly.
LEAF = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by seven half-size products a level, odd sides padded with zeros.

    All arithmetic is integer arithmetic modulo 2**64, so intermediate sums may wrap and every entry
    that fits 64 bits is exact.
    """
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((m, n), dtype=a.dtype)
    c[:h, :j] = p1 + p4 - p5 + p7
    c[:h, j:] = p3 + p5
    c[h:, :j] = p2 + p4
    c[h:, j:] = p1 - p2 + p3 + p6
    return c


def push(heap: list, k: int, scores: np.ndarray, ids: np.ndarray, tids: np.ndarray) -> None:
    """Merge rows into a heap of the ``k`` best (score, -vec_id, -tid); its worst entry is on top.

    Heaps of parts of the rows merge to the heap of all rows, in any order.
    """
    if len(heap) == k:
        fit = np.flatnonzero(scores >= heap[0][0])
        scores, ids, tids = scores[fit], ids[fit], tids[fit]
    if len(scores) > k:
        fit = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids, tids = scores[fit], ids[fit], tids[fit]
    for j in np.lexsort((tids, ids, ~scores))[:k].tolist():
        entry = (int(scores[j]), -int(ids[j]), -int(tids[j]))
        if len(heap) < k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)


def _meet(anchors: DataFrame, candidates: DataFrame, extra: list[str], parts: int) -> DataFrame:
    """Rows for tasks that hold a block of anchors and let candidate blocks pass, the anchors first.

    A candidate block is shipped once per anchor block (1/100 of the rows, 4,096 at a time), an anchor
    block once per share of the candidate blocks; the key is the dimension, the anchor block and the share.
    """
    groups = anchors.groupBy("dim").agg((F.max("block") + 1).alias("groups"))
    shares = F.greatest(F.lit(1), F.ceil(F.lit(2 * parts) / F.col("groups"))).cast("int")
    columns = ["dim", "group", "share", "candidate", "block", "tid", "vec_id", "label", "matrix", *extra]
    held = (
        anchors.join(groups, "dim")
        .withColumnsRenamed({"block": "group"})
        .withColumns({"share": F.explode(F.sequence(F.lit(0), shares - 1)), "candidate": F.lit(0), "block": F.lit(-1)})
        .select(*columns)
    )
    passing = (
        candidates.join(groups, "dim")
        .withColumns({"group": F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "share": F.pmod("block", shares), "candidate": F.lit(1)})
        .withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in extra})
        .select(*columns)
    )
    keys = ["dim", "group", "share"]
    return held.unionByName(passing).repartition(parts, *keys).sortWithinPartitions(*keys, "candidate", "block")


def _tiles(batches, start, visit, finish):
    """Walk the rows of :func:`_meet`: ``start`` anchors, ``visit`` their tiles strip by strip, ``finish``."""
    key = held = None
    for batch in batches:
        for at in range(batch.num_rows):
            x = batch.slice(at, 1).to_pylist()[0]
            if key != (x["dim"], x["group"], x["share"]):
                if held is not None:
                    yield finish(held)
                key, held = (x["dim"], x["group"], x["share"]), None
            if not x["candidate"]:
                held = start(x)
                held["anchors"] = matrix_of(x["matrix"], "<i8", x["dim"])
            elif held is not None:
                matrix = matrix_of(x["matrix"], "<i8", x["dim"]).T
                ids, tids, labels = (np.array(x[c], dtype=np.int64) for c in ("vec_id", "tid", "label"))
                for begin in range(0, len(held["anchors"]), STRIP):
                    scores = strassen(held["anchors"][begin : begin + STRIP], matrix)
                    for i, row in enumerate(scores, begin):
                        visit(held, i, row, ids, tids, labels)
    if held is not None:
        yield finish(held)


def _rows(flat: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*flat, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _best_positives(k: int):
    """Task function: the ``k`` best rows of the same label per anchor."""
    names = ["dim", "group", "anchor_tid", "positive_score", "positive_id", "positive_tid"]

    def start(x):
        return {"dim": x["dim"], "group": x["group"], "tid": x["tid"], "label": x["label"], "heaps": [[] for _ in x["tid"]]}

    def visit(held, i, scores, ids, tids, labels):
        same = np.flatnonzero((labels == held["label"][i]) & (tids != held["tid"][i]))
        push(held["heaps"][i], k, scores[same], ids[same], tids[same])

    def finish(held):
        return _rows(
            [(held["dim"], held["group"], t, s, -v, -r) for t, heap in zip(held["tid"], held["heaps"], strict=True) for s, v, r in heap], names
        )

    return lambda batches: _tiles(batches, start, visit, finish)


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score with low * positive <= 100 * score <= high * positive."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _best_negatives(k: int, low: int, high: int):
    """Task function: the ``k`` best rows of another label inside the window of each positive of an anchor."""
    names = ["anchor_tid", "positive_tid", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_tid", "negative_score"]

    def start(x):
        windows = {}
        for p in x["positives"]:
            lo, hi = window(p["positive_score"], low, high)
            if lo <= hi:
                windows.setdefault(p["anchor_tid"], []).append((lo, hi, p, []))
        return {"ids": x["vec_id"], "label": x["label"], "windows": [windows.get(t, []) for t in x["tid"]]}

    def visit(held, i, scores, ids, tids, labels):
        windows = held["windows"][i]
        if not windows:
            return
        least, most = min(w[0] for w in windows), max(w[1] for w in windows)
        other = np.flatnonzero((scores >= least) & (scores <= most) & (labels != held["label"][i]))
        found = scores[other]
        for lo, hi, _, heap in windows:
            fit = np.flatnonzero((found >= lo) & (found <= hi))
            if len(fit):
                push(heap, k, found[fit], ids[other[fit]], tids[other[fit]])

    def finish(held):
        flat = [
            (p["anchor_tid"], p["positive_tid"], anchor, p["positive_id"], p["positive_score"], -v, -r, s)
            for anchor, windows in zip(held["ids"], held["windows"], strict=True)
            for _, _, p, heap in windows
            for s, v, r in heap
        ]
        return _rows(flat, names)

    return lambda batches: _tiles(batches, start, visit, finish)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    Components x become floor(256 x); a row's score is its integer inner product with the anchor.
    Higher scores come first, ties by smaller ``vec_id``. Anchors are the rows whose ``vec_id`` is
    divisible by ``every``; an anchor's positives are its best other rows of the same label. For each
    positive the best rows of another label follow whose score lies between ``low`` and ``high``
    percent of the positive's (compared in integers, both ends included; there are none for a
    negative positive score).

    Rows with a null ``vec_id``, a null label, or a vector that is null, empty or holds null or
    non-finite components take no part; vectors of different length are not compared. Rows with equal
    ``vec_id`` are separate rows, also as anchors. Scores that do not fit a long wrap. An empty table
    gives no rows. Other columns are ignored.

    Two passes over all tiles of anchors and candidates: the first leaves a heap of positives per
    anchor, the second a heap per (anchor, positive). A task holds the heaps of one block of anchors;
    heaps of different tasks are merged by a window that Spark prunes before the shuffle.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
        .select(
            "vec_id", "label",
            F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("v"),
            F.monotonically_increasing_id().alias("tid"),
            F.size("embedding").alias("dim"),
        )
    )
    parts = width(spark)
    columns = ["tid", "vec_id", "label"]
    candidates = written(pack_blocks(block_numbers(rows), columns, "v", "<i8", parts))
    asked = rows.where(F.col("vec_id") % every == 0)
    anchors = written(pack_blocks(block_numbers(asked, ANCHOR_BLOCK), columns, "v", "<i8", parts))

    schema = "dim int, group int, anchor_tid long, positive_score long, positive_id long, positive_tid long"

    def narrow(batches):
        for found in _best_positives(positives)(batches):
            yield pa.RecordBatch.from_arrays([found.column(c).cast(pa.int32()) if c < 2 else found.column(c) for c in range(6)], found.schema.names)

    found = map_arrow(_meet(anchors, candidates, [], parts), narrow, schema, 1)
    order = Window.partitionBy("anchor_tid").orderBy(F.col("positive_score").desc(), "positive_id", "positive_tid")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # at most ANCHOR_BLOCK times ``positives`` entries a row
    listed = written(
        best.groupBy("dim", F.col("group").alias("block"))
        .agg(F.collect_list(F.struct("anchor_tid", "positive_tid", "positive_id", "positive_score")).alias("positives"))
    )
    armed = anchors.join(listed, ["dim", "block"])

    schema = (
        "anchor_tid long, positive_tid long, anchor_id long, positive_id long, positive_score long, "
        "negative_id long, negative_tid long, negative_score long"
    )
    mined = written(map_arrow(_meet(armed, candidates, ["positives"], parts), _best_negatives(negatives, low, high), schema, 1))
    order = Window.partitionBy("anchor_tid", "positive_tid").orderBy(F.col("negative_score").desc(), "negative_id", "negative_tid")
    return (
        mined.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
