"""Registered queries on operators that stand alone: names, confidences, reuse, warnings, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import fusion as fu
from evigraph.operators import memo as me
from evigraph.operators import pairs as pr
from evigraph.operators import predict as pd_
from evigraph.operators import safety as sf
from evigraph.operators import vector_index as vi
from evigraph.plans.tables import rnd, rounded, table
from evigraph.session import cut_lineage


def latest_names(spark, sf_dir):
    """The priority of a customer's last order stands for its name."""
    return pr.last_names(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


def quick_confidence(spark, sf_dir):
    """Clicks as entities and purchases as predictions of a user's query."""
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind)
    entities = of("click").select(F.col("user_id").alias("query_id"), F.col("value").alias("confidence_score"))
    predictions = of("purchase").select(
        F.col("user_id").alias("query_id"), F.col("value").alias("confidence"), (F.lit(1000) - F.col("value")).alias("uncertainty"))
    users = events.select(F.col("user_id").alias("query_id")).distinct()
    return rounded(fu.simple_confidence(entities, predictions, users), "confidence", "uncertainty")


def duplicated_sources(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return fu.duplicated_sources(events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source_type")))


def aligned_vectors(spark, sf_dir):
    """Documents as vocabulary entries; those without a stored vector get zeros."""
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("feature_id"), F.col("doc_id").alias("idx"))
    stored = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("feature_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = pd_.align_embeddings(entries, stored, 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("feature_id", "idx", F.size("embedding").alias("dim"), rnd(total).alias("total"))


def store_invalidated(spark, sf_dir):
    """Stored results without one component and without the keys that begin with a."""
    parts = table(spark, sf_dir, "part")
    store = parts.select(F.col("p_brand").alias("component"), F.md5(F.col("p_partkey").cast("string")).alias("key_hash"), F.col("p_partkey").alias("input"))
    return me.invalidate(me.invalidate(store, component="Brand#11"), pattern="a%")


def threshold_warnings(spark, sf_dir):
    """Warnings from a confidence that grows with the length of a document."""
    docs = table(spark, sf_dir, "documents")
    c = F.least(F.lit(1.0), F.col("n_chars") / 4000)
    return docs.select("doc_id", F.array_join(sf.threshold_warnings(c, 1 - c), " / ").alias("warnings"))


def vector_topk_index(spark, sf_dir):
    """Five nearest vectors of every hundredth vector through the inverted file."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("collection"), F.col("vec_id").alias("chunk_id"), "embedding")
    cells = vi.fit_cells(rows)
    asked = rows.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return rounded(vi.search_index(asked, cut_lineage(vi.build_index(rows, cells)), cells, threshold=-3.0), "distance")


QUERIES = {
    "vector_topk_index": (vector_topk_index, None),
    "latest_names": (latest_names, "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey"),
    "quick_confidence": (quick_confidence, """WITH u AS (SELECT DISTINCT user_id AS query_id FROM events)
        SELECT query_id,
          round(coalesce((SELECT avg(value) FROM events WHERE user_id = query_id AND event_type IN ('click', 'purchase')), 0.5) + 1e-9, 6) AS confidence,
          round(coalesce((SELECT avg(1000 - value) FROM events WHERE user_id = query_id AND event_type = 'purchase'), 0.5) + 1e-9, 6) AS uncertainty
        FROM u"""),
    "duplicated_sources": (duplicated_sources, """SELECT user_id AS query_id, event_type AS source_type, count(*) AS n
        FROM events GROUP BY ALL HAVING count(*) > 1"""),
    "aligned_vectors": (aligned_vectors, """SELECT doc_id AS feature_id, doc_id AS idx, 64 AS dim,
        round(coalesce(list_sum(embedding::DOUBLE[]), 0) + 1e-9, 6) AS total FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""),
    "store_invalidated": (store_invalidated, """SELECT p_brand AS component, md5(p_partkey::VARCHAR) AS key_hash, p_partkey AS input
        FROM part WHERE p_brand <> 'Brand#11' AND md5(p_partkey::VARCHAR) NOT LIKE 'a%'"""),
    "threshold_warnings": (threshold_warnings, """WITH c AS (SELECT doc_id, least(1.0, n_chars / 4000) AS c FROM documents)
        SELECT doc_id, concat_ws(' / ', CASE WHEN c < 0.8 THEN 'Low confidence: seek professional advice.' END,
          CASE WHEN 1 - c > 0.6 THEN 'High uncertainty: have a person review this.' END,
          CASE WHEN 1 - c > 0.7 THEN 'The analysis is significantly uncertain.' END) AS warnings FROM c"""),
}
