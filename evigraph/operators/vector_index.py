"""Inverted file of centroids: approximate similarity search whose probes follow from a measured margin.

Every usable chunk vector is assigned to its nearest centroid. A query looks into the cells whose
border (the plane midway between two centroids) is no farther from it than the margin, so a query
near many borders looks into more cells than one in the middle of a cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.operators.retrieval import CHUNK_ROWS, MAX_RESULTS, QUERY_ROWS, SIMILARITY_THRESHOLD, _best, merge_results
from evigraph.session import cut_lineage

# Vectors that the centroids are fitted on, and those of them that the margin is measured with. Every
# vector is indexed; only the fit is bounded.
SAMPLE_ROWS = 8_000
MEASURED = 400
# Sample vectors a cell has on average at least, so that the number of cells is bounded too.
CELL_ROWS = 16
ROUNDS = 12
# Part of the nearest vectors of the sample that the margin has to reach.
TARGET = 0.97
SEED = 5


@dataclass(frozen=True)
class Cells:
    """Centroids, the probing margin and the number of components of indexed vectors."""

    centroids: np.ndarray
    margin: float
    metric: str

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def usable(vector: str | Column) -> Column:
    """Whether a vector is there, has components and all of them are finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
    return x


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2.0 * (x @ centroids.T), 0.0)


def _borders(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distance of each vector to the border of each cell, 0 for its own."""
    d = _squared(x, centroids)
    own = d.argmin(axis=1)
    apart = np.sqrt(_squared(centroids, centroids))[own]
    rows = np.arange(len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        away = np.where(apart > 0, (d - d[rows, own][:, None]) / (2 * apart), 0.0)
    away[rows, own] = 0.0
    return away


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows of a bounded sample."""
    centroids = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squared(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=k)
        filled = count > 0  # an empty cell keeps its centroid
        centroids[filled] = sums[filled] / count[filled, None]
    return centroids


def fit_cells(
    chunks: DataFrame, metric: str = "l2sq", n_results: int = MAX_RESULTS, target: float = TARGET, sample_rows: int = SAMPLE_ROWS, cells: int | None = None
) -> Cells | None:
    """Centroids and margin from about ``sample_rows`` vectors of ``chunk_id, embedding``, those with small hashes.

    There are as many cells as the root of the number of vectors, unless the sample is too small for
    them. The margin is the least with which ``target`` of the ``n_results`` nearest sample vectors of
    ``MEASURED`` others lie in probed cells; in the whole collection the nearest are nearer still. The
    length of most sample vectors is that of the index. None without a usable vector.
    """
    vectors = chunks.where(usable("embedding"))
    total = vectors.count()
    if not total:
        return None
    draw = F.xxhash64(F.lit("sample"), "chunk_id") / F.lit(2.0**64) + F.lit(0.5)
    taken = vectors if total <= sample_rows else vectors.where(draw < sample_rows / total)
    rows = [list(r.v) for r in taken.select(F.transform("embedding", lambda x: x.cast("double")).alias("v"), "chunk_id").orderBy(F.xxhash64("chunk_id"), "chunk_id").collect()]
    if not rows:
        rows = [list(vectors.select(F.transform("embedding", lambda x: x.cast("double")).alias("v")).first().v)]
    sizes = [len(r) for r in rows]
    dim = max(sorted(set(sizes)), key=sizes.count)
    x = _matrix(pd.Series([r for r in rows if len(r) == dim]), metric)
    k = cells or max(1, min(round(total**0.5), len(x) // CELL_ROWS))
    centroids = np.unique(_means(x, min(k, len(x))), axis=0)
    asked = x[:: max(1, len(x) // MEASURED)][:MEASURED]
    d = _squared(asked, x)
    d[np.arange(len(asked)), np.arange(0, len(x), max(1, len(x) // MEASURED))[:MEASURED]] = np.inf  # not itself
    near = np.argsort(d, axis=1, kind="stable")[:, : min(n_results, max(len(x) - 1, 0))]
    home = _squared(x, centroids).argmin(axis=1)
    needed = np.take_along_axis(_borders(asked, centroids), home[near], axis=1).ravel()
    margin = float(np.quantile(needed, target, method="higher")) if len(needed) else 0.0
    return Cells(centroids, margin, metric)


def build_index(chunks: DataFrame, cells: Cells) -> DataFrame:
    """``chunks`` (``collection, chunk_id, embedding`` and others) with the cell of every vector.

    Vectors that are null, empty, not finite, or of another length than the index get a null cell and
    are never found. Written partitioned by ``cell`` the table is pruned to the probed cells.
    """
    centroids, metric = cells.centroids, cells.metric

    @F.pandas_udf(T.IntegerType())
    def nearest(vectors: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=vectors.index, dtype="Int32")
        there = vectors.notna()
        if there.any():
            out[there] = _squared(_matrix(vectors[there], metric), centroids).argmin(axis=1).astype("int32")
        return out

    fit = usable("embedding") & (F.size("embedding") == cells.dim)
    return chunks.withColumn("cell", nearest(F.when(fit, F.transform("embedding", lambda x: x.cast("double")))))


def search_index(
    queries: DataFrame, index: DataFrame, cells: Cells, n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD,
    query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Nearest chunks among the probed cells, by exact distances: the shape of :func:`retrieval.search_vectors`.

    ``queries``: ``query_id, embedding``. Queries without a usable vector of the index's length find
    nothing. Ties go to the smaller ``chunk_id``. A cell's chunks are dealt in blocks of about
    ``chunk_rows`` and its queries in blocks of about ``query_rows``, so no task holds a hot cell; a chunk
    is shipped once per block of queries that probe its cell.
    """
    centroids, metric, margin = cells.centroids, cells.metric, cells.margin

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probed(vectors: pd.Series) -> pd.Series:
        away = _borders(_matrix(vectors, metric), centroids)
        return pd.Series([np.flatnonzero(row <= margin + 1e-12).astype("int32") for row in away], index=vectors.index)

    fit = usable("embedding") & (F.size("embedding") == cells.dim)
    asked = queries.where(fit).select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    asked = cut_lineage(asked.withColumn("cell", F.explode(probed("embedding"))))
    held = index.where(F.col("cell").isNotNull()).select(
        "collection", "chunk_id", "cell", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )
    blocks = lambda rows, size, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    # one row a cell; their number is bounded by the sample
    plan = F.broadcast(blocks(asked, query_rows, "qs").join(blocks(held, chunk_rows, "cs"), "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = held.join(plan, "cell").withColumn("cb", deal("chunk_id", "cs")).withColumn("qb", every("qs")).drop("qs", "cs")
    right = asked.join(plan, "cell").withColumn("qb", deal("query_id", "qs")).withColumn("cb", every("cs")).drop("qs", "cs")

    limit = 1.0 - threshold

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["query_id", "collection", "chunk_id", "distance"])
        block = (b["query_id"].to_numpy(), np.stack([np.asarray(v, dtype="float64") for v in b["embedding"]]))
        return _best(block, a, n_results, limit, metric)

    keys = ["cell", "cb", "qb"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        pair, "query_id BIGINT, collection STRING, chunk_id BIGINT, distance DOUBLE"
    )
    return merge_results(local, n_results, threshold)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Part of the exact results that the index found, one row: ``exact, hits, recall``."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")).distinct(), ["query_id", "chunk_id"], "left")
    return hit.agg(
        F.count(F.lit(1)).alias("exact"), F.count("_hit").alias("hits"), (F.count("_hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall")
    )
