"""Exact top-k inner products by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.blocks import block_numbers, matrix_of, pack_blocks, usable
from evigraph.llm.common import map_arrow, width, written

SCALE = 256
QUERY_BLOCK = 512
# Entries read from every list before the first look at the bound; twice as many before each next one.
STEP = 16


def sorted_lists(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension the rows in ascending order of the component, and the components in that order."""
    order = np.argsort(matrix, axis=0, kind="stable").T.copy()
    return order, np.take_along_axis(matrix.T, order, axis=1)


def threshold_search(query: np.ndarray, own: int, matrix: np.ndarray, ids: np.ndarray, tids: np.ndarray, lists: tuple, k: int, best: list) -> list:
    """The k best of ``best`` (score, -vec_id, tid) and the rows of ``matrix``, ties to the smaller id.

    Each dimension's list is read from the end at which it adds most; rows met in any list are scored
    in full. No row unseen by then can exceed the sum over the dimensions of query times the next
    unread component, so the search stops when that bound is below the k-th score. On a tie it goes
    on, as an unseen row may have the smaller id.
    """
    order, values = lists
    n = len(ids)
    up = np.flatnonzero(query < 0)
    down = np.flatnonzero(query > 0)
    new = np.zeros(n, dtype=bool)
    seen = np.zeros(n, dtype=bool)
    depth, step = 0, STEP
    while depth < n:
        upto = min(depth + step, n)
        step *= 2
        if len(up) or len(down):
            new[order[up, depth:upto]] = True
            new[order[down, n - upto : n - depth]] = True
        else:
            new[:] = True  # all scores are 0
            upto = n
        fresh = np.flatnonzero(new & ~seen)
        seen |= new
        if len(fresh):
            score = matrix[fresh] @ query
            floor = best[-1][0] if len(best) == k else -np.inf
            fit = np.flatnonzero(score >= floor)
            if len(fit) > 4 * k:  # the query's own row may be one of the best
                low = np.partition(score[fit], len(fit) - k - 1)[len(fit) - k - 1]
                fit = fit[score[fit] >= low]
            rows = fresh[fit]
            best = sorted(
                [*best, *((int(s), -int(ids[r]), int(tids[r])) for s, r in zip(score[fit], rows, strict=True) if tids[r] != own)], reverse=True
            )[:k]
        depth = upto
        if seen.all():
            break
        if len(best) == k and depth < n:
            bound = values[up, depth] @ query[up] + values[down, n - 1 - depth] @ query[down]
            if best[-1][0] > bound:
                break
    return best


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: best rows of ``vec_id, embedding`` for every ``every``-th id.

    Components x become floor(256 x); the score is the integer inner product with every row but the
    query's own, ties go to the smaller ``vec_id``. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows with a null id; vectors of different length are
    not compared. Rows with equal ``vec_id`` are separate rows. Other columns are ignored.

    Candidates and queries are packed in blocks; a task takes one block of queries through a share of
    the candidate blocks in turn, carrying the k best so far, which only tightens the bound. What
    leaves a task is k rows a query.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & usable("embedding"))
        .select(
            "vec_id",
            F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double")).alias("v"),
            F.monotonically_increasing_id().alias("tid"),
            F.size("embedding").alias("dim"),
        )
    )
    parts = width(spark)
    columns = ["tid", "vec_id"]
    candidates = written(pack_blocks(block_numbers(rows), columns, "v", "<f8", parts))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = written(pack_blocks(block_numbers(asked, QUERY_BLOCK), columns, "v", "<f8", parts))
    n_queries = max(1, queries.count())
    shares = max(1, 2 * parts // n_queries)
    left = queries.select(
        "dim", F.col("block").alias("query"), F.col("tid").alias("query_tid"), F.col("vec_id").alias("query_id"), F.col("matrix").alias("query_matrix"),
    )
    # blocks against blocks of the stated query set; the key is the dimension and the share
    share = F.pmod("block", F.lit(shares))
    spread = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    pairs = spread.join(candidates.withColumn("share", share), ["dim", "share"])
    keys = ["dim", "query", "share"]
    dealt = pairs.repartition(parts, *keys).sortWithinPartitions(*keys, "block")

    def run(batches):
        last, held, best = None, None, []

        def result():
            flat = [(int(q), s, -i, t) for q, found in zip(held, best, strict=True) for s, i, t in found]
            cols = list(zip(*flat, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_tid", "score", "vec_id", "tid"])

        for batch in batches:
            for x in batch.to_pylist():
                key = (x["dim"], x["query"], x["share"])
                if key != last:
                    if last is not None:
                        yield result()
                    last, held, best = key, x["query_tid"], [[] for _ in x["query_tid"]]
                matrix = matrix_of(x["matrix"], "<f8", x["dim"])
                ids, tids = np.array(x["vec_id"]), np.array(x["tid"])
                lists = sorted_lists(matrix)
                for i, q in enumerate(matrix_of(x["query_matrix"], "<f8", x["dim"])):
                    best[i] = threshold_search(q, held[i], matrix, ids, tids, lists, k, best[i])
        if last is not None:
            yield result()

    found = map_arrow(dealt, run, "query_tid long, score long, vec_id long, tid long", 1)
    order = Window.partitionBy("query_tid").orderBy(F.col("score").desc(), "vec_id", "tid")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("tid").alias("query_tid"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_tid").select("query_id", "rank", "vec_id", "score")
