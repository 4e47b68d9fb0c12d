"""Registered queries of the training-data operators with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import table
from evigraph.llm.licences import licence_digest, scan_licences
from evigraph.llm.mixing import mix
from evigraph.llm.neardup import near_duplicates
from evigraph.llm.negatives import hard_negatives
from evigraph.llm.packing import pack_documents
from evigraph.llm.quality import classify
from evigraph.llm.sharding import shard
from evigraph.llm.suffixdup import repeat_digest
from evigraph.llm.tokens import token_histogram
from evigraph.llm.topk import top_k
from evigraph.llm.urls import judge, labelled_by_rules
from evigraph.llm.vectordup import near_vectors
from evigraph.llm.whitening import whiten


def op1_quality_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a conditional random field over their lines."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded lengths of all documents with the suffix sums for every context limit."""
    return token_histogram(table(spark, sf_dir, "documents"))


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows of all embeddings for every fiftieth."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 with at most three epochs a source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17|' || doc_id) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM s),
w AS (
  SELECT *,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT)::DOUBLE
      / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM w WHERE cap >= weight * level),
t AS (
  SELECT r.source, source_size, CASE WHEN cap < weight * level THEN cap::DOUBLE ELSE weight * level END AS target
  FROM r, l),
q AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM t),
p AS (
  SELECT doc_id, size, q.source_size, target, whole,
         floor(target + 0.5)::BIGINT - whole * q.source_size AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw)::BIGINT AS upto,
         sum(size) OVER (PARTITION BY d.source, draw)::BIGINT AS part,
         count(*) OVER (PARTITION BY d.source, draw) AS ties
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + CASE WHEN upto <= quota AND NOT (quota <= upto AND quota > upto - part) THEN size
                            WHEN quota > upto - part THEN least(size, (quota - (upto - part)) // ties)
                            ELSE 0 END)::BIGINT AS taken
FROM p
"""


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.ok AND b.ok AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (
  SELECT vec_id AS u, vec_id AS root FROM v
  UNION
  SELECT l.w, c.root FROM c JOIN l ON l.u = c.u)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, min(c.root) AS component_id,
       min(c.root) = v.vec_id AS kept
FROM v JOIN c ON c.u = v.vec_id GROUP BY v.vec_id
"""


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 200 bytes that start anywhere else too."""
    return repeat_digest(table(spark, sf_dir, "documents"))


def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    return shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents at a Jaccard similarity of 0.8 on five-word n-grams."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), 4096)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and identifier tags of all documents."""
    return licence_digest(scan_licences(table(spark, sf_dir, "documents")))


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth embedding."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their four largest components."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all page URLs; the trees learn from the URLs that rules decide."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_by_rules(pages))


QUERIES = {
    "op1_quality_field": (op1_quality_field, None),
    "op2_token_histogram": (op2_token_histogram, None),
    "op3_threshold_topk": (op3_threshold_topk, OP3_SQL),
    "op4_source_mix": (op4_source_mix, OP4_SQL),
    "op5_near_vectors": (op5_near_vectors, OP5_SQL),
    "op6_repeated_bytes": (op6_repeated_bytes, None),
    "op7_lpt_shards": (op7_lpt_shards, None),
    "op8_jaccard_join": (op8_jaccard_join, None),
    "op9_packed_sequences": (op9_packed_sequences, None),
    "op10_licence_scan": (op10_licence_scan, None),
    "op11_strassen_negatives": (op11_strassen_negatives, OP11_SQL),
    "op12_lanczos_whitening": (op12_lanczos_whitening, None),
    "op13_boosted_urls": (op13_boosted_urls, None),
}
