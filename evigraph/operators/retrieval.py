"""Similarity search over chunk collections and the context built from its results.

Distances are squared Euclidean; a result is kept when distance <= 1 - threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions.ordered import top_per_group
from evigraph.session import cut_lineage

# Fixed values that results depend on.
MAX_RESULTS = 5
SIMILARITY_THRESHOLD = 0.0

# Queries and chunks that meet in one task, and chunks multiplied at a time.
QUERY_ROWS = 2_000
CHUNK_ROWS = 20_000
TILE_ROWS = 1_000


def restrict(chunks: DataFrame, collections: Sequence[str] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Chunks of the wanted collections (partition pruning) and metadata values, before any scoring."""
    out = chunks
    if collections is not None:
        out = out.where(F.col("collection").isin(list(collections)))
    for key, value in (metadata or {}).items():
        out = out.where(F.try_element_at("metadata", F.lit(key)) == value)
    return out


def _tile_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - (q @ x.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    return np.maximum(0.0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2.0 * (q @ x.T))


def _best(queries: tuple[np.ndarray, np.ndarray], pdf: pd.DataFrame, n: int, limit: float, metric: str) -> pd.DataFrame:
    """Best n of a block of chunks per query and collection; only these leave the task.

    Chunks are taken a tile at a time; between tiles only the best n of every query are held.
    """
    ids, q = queries
    out = []
    for collection, part in pdf.groupby("collection", sort=False, dropna=False):
        keys = part["chunk_id"].to_numpy()
        embeddings = part["embedding"].to_numpy()
        row, dist, key = np.empty(0, np.int64), np.empty(0), np.empty(0, keys.dtype)
        edge = np.full(len(ids), limit)
        for at in range(0, len(keys), TILE_ROWS):
            x = np.stack([np.asarray(v, dtype="float64") for v in embeddings[at : at + TILE_ROWS]])
            d = _tile_distances(q, x, metric)
            if d.shape[1] > n:
                edge = np.minimum(edge, np.partition(d, n - 1, axis=1)[:, n - 1])
            i, j = np.nonzero(d <= edge[:, None] + 1e-9)
            row, dist, key = np.concatenate((row, i)), np.concatenate((dist, d[i, j])), np.concatenate((key, keys[at + j]))
            order = np.lexsort((key, np.round(dist, 9), row))
            row, dist, key = row[order], dist[order], key[order]
            first = np.searchsorted(row, np.arange(len(ids)))
            keep = np.arange(len(row)) - first[row] < n
            row, dist, key = row[keep], dist[keep], key[keep]
        out.append(pd.DataFrame({"query_id": ids[row], "collection": collection if isinstance(collection, str) else None, "chunk_id": key, "distance": dist}))
    cols = ["query_id", "collection", "chunk_id", "distance"]
    return pd.concat(out, ignore_index=True)[cols] if out else pd.DataFrame(columns=cols)


def search_vectors(
    queries: DataFrame, chunks: DataFrame, n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD, metric: str = "l2sq",
    query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Exact nearest chunks of dense query vectors: n per collection, merged, cut to n.

    ``queries``: ``query_id BIGINT, embedding``; ``chunks``: ``collection, chunk_id BIGINT, embedding``.
    Blocks of queries meet blocks of chunks in an equi-join on the block numbers; a task multiplies
    them tile by tile and lets only the best n per query and collection out. Null is a collection.
    """
    limit = 1.0 - threshold
    # a column of its own, as queries may be rows of the chunks
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    c = chunks.select("collection", "chunk_id", "embedding")
    q_blocks = max(1, -(-q.count() // query_rows))
    c_blocks = max(1, -(-c.count() // chunk_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = c.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(c_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    right = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("cb", every(c_blocks))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["query_id", "collection", "chunk_id", "distance"])
        block = (b["query_id"].to_numpy(), np.stack([np.asarray(v, dtype="float64") for v in b["embedding"]]))
        return _best(block, a, n_results, limit, metric)

    schema = "query_id BIGINT, collection STRING, chunk_id BIGINT, distance DOUBLE"
    local = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(pair, schema)
    return merge_results(local, n_results, threshold)


def merge_results(scored: DataFrame, n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """n best per query and collection, then n best per query under the threshold."""
    near = [F.round("distance", 9), F.asc("chunk_id")]
    per = top_per_group(scored, ["query_id", "collection"], near, n_results).drop("rank")
    order = [F.round("distance", 9), F.asc("collection"), F.asc("chunk_id")]
    return top_per_group(per.where(F.col("distance") <= 1.0 - threshold + 1e-9), ["query_id"], order, n_results)


def term_weights(texts: DataFrame, id_col: str, text_col: str = "text", idf: DataFrame | None = None) -> DataFrame:
    """Unit-length TF-IDF vectors as rows ``id, term, w``; words of every text weigh nothing and go.

    Passing the ``idf`` table of the searched corpus puts queries into the same space.
    """
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+")).alias("term")).where(F.col("term") != "")
    tf = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = inverse_frequency(tf) if idf is None else idf
    raw = tf.join(idf, "term").withColumn("_x", F.col("tf") * F.col("idf")).where(F.col("_x") > 0)
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_l"))
    return raw.join(norm, "id").select("id", "term", "idf", (F.col("_x") / F.col("_l")).alias("w"))


def inverse_frequency(tf: DataFrame, n=None) -> DataFrame:
    """ln((texts + 1) / (texts with the term + 1)) per term of ``id, term`` rows; ``n`` (texts) if it is known."""
    n = tf.agg(F.count_distinct("id")).scalar() if n is None else n
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", F.log((n + 1) / (F.col("df") + 1)).alias("idf"))


def _prefix(vectors: DataFrame, cosine: float) -> DataFrame:
    """Terms of each vector, rarest first, up to where the rest is too short to reach the cosine.

    If two unit vectors reach it, the rarest term they share lies in both prefixes, so frequent
    words need not be joined at all. The window holds one text's own terms.
    """
    from pyspark.sql import Window

    rest = Window.partitionBy("id").orderBy(F.asc("idf"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    return vectors.withColumn("_rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).where(F.col("_rest") >= cosine - 1e-9)


def reachable(queries: DataFrame, words: DataFrame, chunks: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``chunk_id`` of the chunks that can be near enough to a question, before their vectors are made.

    ``queries``: ``id, term, idf, w``; ``words``: distinct ``id, term`` of a chunk's row. The cosine of two unit
    vectors is at most the length of the first one over the terms they share. Shared rare terms are counted;
    the frequent rest of a question, shorter than half of what is needed, is taken as shared. Rows with one
    id are one chunk, whose product counts once for each of them.
    """
    cosine = (1.0 + threshold) / 2.0
    rare = cut_lineage(_prefix(queries, cosine / 2).select(F.col("id").alias("query_id"), "term", (F.col("w") * F.col("w")).alias("_m")))
    rest = rare.groupBy("query_id").agg((1.0 - F.sum("_m")).alias("_rest"))
    shared = rare.join(words, "term").groupBy("query_id", "id").agg(F.sum("_m").alias("_m"))
    often = chunks.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    near = shared.join(rest, "query_id").join(often, "id", "left")
    if cosine > 0:
        near = near.where(n * n * (F.col("_m") + F.col("_rest")) >= cosine * cosine - 1e-9)
    return near.select(F.col("id").alias("chunk_id")).distinct()


def permitted(pairs: DataFrame, filters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs ``query_id, chunk_id`` that the question's own filters let through.

    ``filters``: ``query_id, collections, wanted``. A null list of collections or a null map of metadata
    values asks for nothing; a chunk without the collection or value that is asked for does not pass.
    """
    asked = filters.select("query_id", "collections", "wanted")
    holds = lambda e: F.coalesce(F.try_element_at("metadata", e["key"]) == e["value"], F.lit(False))
    return (
        pairs.join(asked, "query_id").join(chunks.select("chunk_id", "collection", "metadata"), "chunk_id")
        .where(F.col("collections").isNull() | F.array_contains("collections", F.col("collection")))
        .where(F.col("wanted").isNull() | F.forall(F.map_entries("wanted"), holds))
        .select("query_id", "chunk_id")
    )


def search_terms(queries: DataFrame, chunks: DataFrame, n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD,
                 keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nearest chunks of sparse unit vectors under the threshold, exactly.

    ``queries``: ``id, term, idf, w``; ``chunks``: the same plus ``collection``. Squared distance
    d = 2 - 2 cos, so d <= 1 - threshold means cos >= (1 + threshold) / 2. ``keep`` drops candidate
    pairs ``query_id, chunk_id`` before they are scored.
    """
    cosine = (1.0 + threshold) / 2.0
    left = _prefix(queries, cosine).select(F.col("id").alias("query_id"), "term")
    right = _prefix(chunks.select("id", "term", "idf", "w"), cosine).select(F.col("id").alias("chunk_id"), "term")
    pairs = left.join(right, "term").select("query_id", "chunk_id").distinct()
    pairs = pairs if keep is None else keep(pairs)
    dot = (
        pairs.join(queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("_a")), "query_id")
        .join(chunks.select(F.col("id").alias("chunk_id"), "term", "collection", F.col("w").alias("_b")), ["chunk_id", "term"])
        .groupBy("query_id", "chunk_id", "collection").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    )
    scored = dot.withColumn("distance", F.greatest(F.lit(0.0), 2 - 2 * F.col("_dot"))).drop("_dot")
    return merge_results(scored.where(F.col("distance") <= 1.0 - threshold + 1e-9), n_results, threshold)


def format_results(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with text, relevance (1 - distance) and source fields of the stored metadata."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    kept = chunks.select("chunk_id", "text", "metadata")
    return results.join(kept, "chunk_id").select(
        "query_id", "rank", "chunk_id", "collection", "text", (1 - F.col("distance")).alias("relevance_score"),
        *[meta(k) for k in ("document_id", "source_file", "document_type", "patient_id", "date", "page_count", "chunk_index", "start_char", "end_char")])


def response_context(formatted: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """Context text per query from its best chunks, a fixed sentence where there are none."""
    source = F.concat(F.lit("Source: "), F.coalesce("source_file", F.lit("unknown")),
                      F.when(F.col("patient_id").isNotNull(), F.concat(F.lit(" (Patient: "), "patient_id", F.lit(")"))).otherwise(""))
    part = F.format_string("[Context %d] %s\n%s\n", "rank", source, "text")
    best = formatted.where(F.col("rank") <= top).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n").alias("context"),
    )
    counts = formatted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    return queries.select("query_id").join(best, "query_id", "left").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit("No relevant documents found.")).alias("context"), F.coalesce("total_results", F.lit(0)).alias("total_results"))


def retrieve(queries: DataFrame, chunks: DataFrame, collections: Sequence[str] | None = None, metadata: dict[str, str] | None = None,
             n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Query texts ``query_id, text`` expanded, matched on text vectors and formatted.

    ``chunks``: ``collection, chunk_id, text, metadata``. Queries may carry filters of their own,
    ``collections`` (list) and ``wanted`` (map of metadata values), see :func:`permitted`; they apply
    before the best are taken, and term weights stay those of all chunks that are searched.
    """
    wanted = restrict(chunks, collections, metadata)
    # texts are taken apart once
    terms = F.array_remove(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), "")
    held = cut_lineage(wanted.select(F.col("chunk_id").alias("id"), terms.alias("terms")))
    words = held.select("id", F.explode("terms").alias("term"))
    idf = cut_lineage(inverse_frequency(words, held.where(F.size("terms") > 0).agg(F.count_distinct("id")).scalar()))
    asked = cut_lineage(term_weights(queries.select("query_id", tx.expand_query(F.col("text")).alias("text")), "query_id", "text", idf))
    # most chunks share too little with any question: vectors are made of the others only
    near = cut_lineage(wanted.join(cut_lineage(reachable(asked, words, wanted, threshold)), "chunk_id", "left_semi"))
    vectors = cut_lineage(term_weights(near, "chunk_id", "text", idf).join(near.select(F.col("chunk_id").alias("id"), "collection"), "id"))
    own = {"collections": "array<string>", "wanted": "map<string,string>"}
    keep = None
    if set(own) & set(queries.columns):
        filters = queries.select("query_id", *[F.col(c) if c in queries.columns else F.lit(None).cast(t).alias(c) for c, t in own.items()])
        keep = lambda pairs: permitted(pairs, filters, near)
    return format_results(search_terms(asked, vectors, n_results, threshold, keep), near)


def retrieve_dense(queries: DataFrame, chunks: DataFrame, collections: Sequence[str] | None = None, metadata: dict[str, str] | None = None,
                   n_results: int = MAX_RESULTS, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Query vectors ``query_id, embedding`` matched on supplied chunk vectors and formatted.

    ``chunks``: ``collection, chunk_id, text, metadata, embedding``.
    """
    wanted = restrict(chunks, collections, metadata)
    return format_results(search_vectors(queries, wanted, n_results, threshold), wanted)
