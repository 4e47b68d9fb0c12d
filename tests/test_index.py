"""The inverted file against exact search, and its edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import retrieval as rt
from evigraph.operators import vector_index as vi
from evigraph.session import cut_lineage, tune

CHUNKS = "collection STRING, chunk_id LONG, embedding ARRAY<DOUBLE>"


def both(spark, rows, queries, metric="l2sq", **sizes):
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame(queries, "query_id LONG, embedding ARRAY<DOUBLE>")
    cells = vi.fit_cells(chunks, metric)
    index = cut_lineage(vi.build_index(chunks, cells))
    sound = chunks.where(vi.usable("embedding") & (F.size("embedding") == cells.dim))
    exact = rt.search_vectors(asked.where(vi.usable("embedding") & (F.size("embedding") == cells.dim)), sound, threshold=-99.0, metric=metric)
    return cells, index, vi.search_index(asked, index, cells, threshold=-99.0, **sizes), exact


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_recall_and_every_vector_has_a_cell(spark, metric):
    tune(spark)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16)) * 2
    rows = [(None if i % 9 == 0 else "ab"[i % 2], i, (middles[rng.integers(30) if i % 3 else 0] + rng.normal(size=16)).tolist()) for i in range(3000)]
    queries = [(i, v) for _, i, v in rows[::50]]
    cells, index, found, exact = both(spark, rows, queries, metric, query_rows=7, chunk_rows=60)
    assert len(cells.centroids) > 20 and index.where("cell is null").count() == 0
    got = vi.recall(found, exact).first()
    assert got.exact == 5 * len(queries) and got.recall >= 0.9
    # a row that the index finds has the exact distance
    want = {(r.query_id, r.chunk_id): r.distance for r in exact.collect()}
    assert all(abs(want[r.query_id, r.chunk_id] - r.distance) < 1e-9 for r in found.collect() if (r.query_id, r.chunk_id) in want)
    # queries look into some of the cells only
    probes = (vi._borders(np.array([v for _, v in queries]), cells.centroids) <= cells.margin).sum(axis=1)
    assert metric == "cosine" or probes.mean() < 0.8 * len(cells.centroids)


def test_odd_vectors_are_never_found_and_ties_go_to_the_smaller_id(spark):
    tune(spark)
    rng = random.Random(2)
    rows = [("c", i, [rng.random(), rng.random()]) for i in range(100)] + [("c", 200 - i, [5.0, 5.0]) for i in range(20)]
    rows += [("c", 900, None), ("c", 901, []), ("c", 902, [float("nan"), 1.0]), ("c", 903, [1.0]), ("c", 904, [None, 1.0]), ("c", 905, [math.inf, 0.0])]
    queries = [(1, [5.0, 5.0]), (2, None), (3, [1.0]), (4, [0.5, float("nan")]), (5, [0.5, 0.5])]
    cells, index, found, exact = both(spark, rows, queries)
    assert {r.chunk_id for r in index.where("cell is null").collect()} == {900, 901, 902, 903, 904, 905}
    got = found.collect()
    assert {r.query_id for r in got} == {1, 5}
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [181, 182, 183, 184, 185]
    assert vi.fit_cells(spark.createDataFrame([("c", 1, None)], CHUNKS)) is None
    one = spark.createDataFrame([("c", 1, [1.0, 2.0])], CHUNKS)
    assert vi.search_index(spark.createDataFrame([(1, [1.0, 2.0])], "query_id LONG, embedding ARRAY<DOUBLE>"), vi.build_index(one, vi.fit_cells(one)), vi.fit_cells(one)).count() == 1
