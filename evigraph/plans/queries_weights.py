"""Registered queries on weights and the graph, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import graph as gr
from evigraph.operators import pairs as pr
from evigraph.operators import weights as wt
from evigraph.functions.ordered import top_per_group
from evigraph.plans.tables import customer_names, pair_bag, rnd, rounded, table
from evigraph.session import checkpoint_dir, cut_lineage
from evigraph.sources import graph_store as gs

MIN_WEIGHT = 0.2



def graph_tables(spark: SparkSession, sf_dir: str):
    return gr.build_graph(wt.combined_weights(pair_bag(spark, sf_dir)), customer_names(spark, sf_dir), MIN_WEIGHT)


def feature_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per supplier: its three most frequent part names stand for the features a user types in."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    counted = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("query_id"), F.col("p_name").alias("feature"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counted, ["query_id"], [F.desc("n"), F.asc("feature")], 3).select("query_id", "feature")


def pair_frequency(spark, sf_dir):
    return rounded(wt.frequency_weights(pair_bag(spark, sf_dir)), "frequency_weight")


def pair_tfidf(spark, sf_dir):
    return rounded(wt.tfidf_weights(pair_bag(spark, sf_dir)), "tf_normalized", "idf", "tfidf_weight")


def pair_pmi(spark, sf_dir):
    return rounded(wt.pmi_weights(pair_bag(spark, sf_dir)), "pmi_raw", "pmi_weight")


def pair_combined(spark, sf_dir):
    df = wt.combined_weights(pair_bag(spark, sf_dir))
    return rounded(df, "tfidf_weight", "tfidf_normalized", "pmi_weight", "pmi_confidence", "final_weight")


def plain_weights(spark, sf_dir):
    df = wt.plain_weights(pair_bag(spark, sf_dir))
    return rounded(df, "frequency_weight", "tfidf_weight", "pmi_weight")


def weight_union(spark, sf_dir):
    bag = pair_bag(spark, sf_dir)
    df = wt.merge_families(
        wt.frequency_weights(bag),
        wt.tfidf_weights(bag).select("entity_id", "feature", "tfidf_weight"),
        wt.pmi_weights(bag).where(F.col("pmi_weight") > 0).select("entity_id", "feature", "pmi_weight"),
    )
    return rounded(df, "frequency_weight", "tfidf_weight", "pmi_weight")


def weight_minmax(spark, sf_dir):
    df = wt.minmax_combined(wt.plain_weights(pair_bag(spark, sf_dir)))
    return rounded(
        df.select("entity_id", "feature", "frequency_weight_norm", "tfidf_weight_norm", "pmi_weight_norm", "combined_weight"),
        "frequency_weight_norm", "tfidf_weight_norm", "pmi_weight_norm", "combined_weight",
    )


def top_features(spark, sf_dir):
    weights = wt.combined_weights(pair_bag(spark, sf_dir)).withColumn("final_weight", rnd("final_weight"))
    return wt.top_features(weights, "final_weight", 10).select("entity_id", "feature", "final_weight", "weight_category", "rank")


def pair_distinct_counts(spark, sf_dir):
    return pr.distinct_counts(wt.pair_counts(pair_bag(spark, sf_dir)))


def symptom_pairs_from_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pr.explode_pairs(docs, "doc_id", "source", "text").withColumn("feature_id", tx.slug_id(F.col("feature")))


def pair_bag_from_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    bag = pr.explode_pairs(docs, "doc_id", "source", "text", distinct=False)
    return bag.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("feature").alias("distinct_items"),
        F.sum(F.length("feature")).alias("chars"),
    )


def graph_stats(spark, sf_dir):
    return gr.graph_statistics(*graph_tables(spark, sf_dir))


def graph_edges(spark, sf_dir):
    _, _, edges = graph_tables(spark, sf_dir)
    return rounded(edges, "weight", "tfidf_weight", "pmi_confidence")


def dated_counts(spark, sf_dir):
    """Pair counts of the line items of the first order years, and of all; joined, counted and written once."""
    counts = cut_lineage(wt.pair_counts(pair_bag(spark, sf_dir, before="1997-01-01"), "early"))
    early = counts.where(F.col("early_tf") > 0).select(*wt.KEYS, F.col("early_tf").alias("tf"))
    return early, counts.drop("early_tf")


def graph_upsert(spark, sf_dir):
    """Stored graph of the first order years, updated with weights of all years."""
    names = customer_names(spark, sf_dir)
    early, counts = dated_counts(spark, sf_dir)
    _, _, stored = gr.build_graph(wt.combined_weights(early, counted=True), names, MIN_WEIGHT)
    _, _, incoming = gr.build_graph(wt.combined_weights(counts, counted=True), names, MIN_WEIGHT)
    return rounded(gr.upsert_edges(stored, incoming), "weight", "tfidf_weight", "pmi_confidence")


def graph_merge(spark, sf_dir):
    """The graph of the first order years in a store, merged with that of all years: nodes, edges and times."""
    names = customer_names(spark, sf_dir)
    early, counts = dated_counts(spark, sf_dir)
    first = gr.build_graph(wt.combined_weights(early, counted=True), names, MIN_WEIGHT)
    full = gr.build_graph(wt.combined_weights(counts, counted=True), names, MIN_WEIGHT)
    path = f"{checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"
    gs.create_store(*first, path, F.lit("1997-01-01").cast("timestamp"))
    gs.merge_store(spark, path, *full, F.lit("1999-01-01").cast("timestamp"))
    entities, features, edges = gs.read_store(spark, path)
    nodes = entities.select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("source_id"), F.lit("").alias("target_id")).unionByName(
        features.select(F.lit("feature").alias("kind"), F.col("id").alias("source_id"), F.lit("").alias("target_id")))
    return nodes.withColumns({"weight": F.lit(None).cast("double"), "updated": F.lit(None).cast("string")}).unionByName(edges.select(
        F.lit("edge").alias("kind"), F.col("entity_id").cast("string").alias("source_id"), F.col("feature_id").alias("target_id"),
        rnd("weight").alias("weight"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")))


def entity_search(spark, sf_dir):
    _, features, _ = graph_tables(spark, sf_dir)
    return gr.search_features(features, "Widget")


def entity_search_by_name(spark, sf_dir):
    entities, _, _ = graph_tables(spark, sf_dir)
    return gr.search_entities(entities, "Customer#00000001")


def entity_validate(spark, sf_dir):
    entities, features, _ = graph_tables(spark, sf_dir)
    nodes = entities.select(F.col("id").cast("string").alias("id"), "name", "display_name", F.lit("Disease").alias("type")).unionByName(
        features.select("id", "name", "display_name", F.lit("Symptom").alias("type"))
    )
    requests = table(spark, sf_dir, "part").select(
        F.upper("p_name").alias("name"), F.when(F.col("p_size") > 25, F.lit("Disease")).alias("type")
    )
    return gr.validate_entities(requests, nodes)


def rank_entities_by_features(spark, sf_dir):
    ranked = gr.rank_entities(feature_queries(spark, sf_dir), *graph_tables(spark, sf_dir), min_weight=0.3, top_n=10)
    return rounded(ranked, "total_score", places=4).withColumn("matched_features", F.array_join("matched_features", ","))


def related_with_additional(spark, sf_dir):
    related = gr.related_with_additional(feature_queries(spark, sf_dir), *graph_tables(spark, sf_dir), min_weight=0.3, top_n=10)
    related = rounded(related, "total_score", "additional_weight", places=4)
    return related.select("query_id", "rank", "entity_id", "total_score", "matched_count", "additional_feature", "additional_weight")


def suggestions(spark, sf_dir):
    related = gr.related_with_additional(feature_queries(spark, sf_dir), *graph_tables(spark, sf_dir), min_weight=0.3, top_n=10)
    return gr.suggestions_json(rounded(related, "total_score", "additional_weight", places=4))


def features_of_entity(spark, sf_dir):
    entities, features, edges = graph_tables(spark, sf_dir)
    return gr.features_of_entity(entities, features, edges, name="customer#000000007").select(
        "entity_id", "entity_name", "feature", rnd("weight").alias("weight"), "category"
    )


def concept_relationships(spark, sf_dir):
    entities, features, edges = graph_tables(spark, sf_dir)
    concepts = entities.select(F.col("id").cast("string").alias("concept_id"), F.lit("DISEASE").alias("concept_type")).unionByName(
        features.select(F.col("name").alias("concept_id"), F.lit("SYMPTOM").alias("concept_type"))
    )
    rel = gr.concept_relationships(concepts, entities, features, edges)
    return rel.groupBy("concept_id", "concept_type").agg(
        F.count(F.lit(1)).alias("neighbours"), rnd(F.sum("weight"), 4).alias("weight_sum"),
        F.min("related").alias("first_related"),
    ).withColumn("definition", tx.concept_definition(F.col("concept_id"), F.col("concept_type")))


def relations(spark, sf_dir):
    df = gr.fetch_relations(*graph_tables(spark, sf_dir), min_weight=0.4)
    return rounded(df, "weight", "tfidf_weight", "pmi_confidence")


# --- SQL counterparts -------------------------------------------------------------------------

PAIRS = """
bag AS (SELECT o_custkey AS entity_id, p_name AS feature
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
counts AS (SELECT entity_id, feature, count(*) AS tf FROM bag GROUP BY ALL),
by_entity AS (SELECT entity_id, sum(tf) AS et FROM counts GROUP BY ALL),
by_feature AS (SELECT feature, sum(tf) AS ft, count(*) AS df FROM counts GROUP BY ALL),
overall AS (SELECT sum(et) AS total, count(*) AS n FROM by_entity),
plain AS (SELECT entity_id, feature, tf / et AS freq, ln(n / df) AS idf, tf / et * ln(n / df) AS tfidf,
                 ln((tf / total) / ((et / total) * (ft / total))) AS pmi,
                 greatest(0, ln((tf / total) / ((et / total) * (ft / total)))) AS ppmi
          FROM counts JOIN by_entity USING (entity_id) JOIN by_feature USING (feature), overall)"""

COMBINED = PAIRS + """,
combined AS (SELECT entity_id, feature, tfidf, coalesce(tfidf / nullif((SELECT max(tfidf) FROM plain), 0), 0) AS norm,
                    ppmi, CASE WHEN ppmi > 0 THEN 1 - exp(-ppmi) ELSE 0 END AS conf FROM plain),
final AS (SELECT *, 0.7 * norm + 0.3 * conf AS w FROM combined),
weighted AS (SELECT *, CASE WHEN w < 0.3 THEN 'Weak' WHEN w < 0.6 THEN 'Moderate' WHEN w < 0.8 THEN 'Strong'
                            ELSE 'Very Strong' END AS category FROM final)"""

GRAPH = COMBINED + f""",
edges AS (SELECT entity_id, 'symptom::' || trim(regexp_replace(lower(feature), '[^a-z0-9]+', '_', 'g'), '_') AS feature_id,
                 feature, w, tfidf, conf, category FROM weighted WHERE w >= {MIN_WEIGHT}),
entities AS (SELECT DISTINCT entity_id, lower(c_name) AS name, upper(c_name[1]) || lower(c_name[2:]) AS display
             FROM edges JOIN customer ON entity_id = c_custkey),
features AS (SELECT DISTINCT feature_id, feature AS name,
             array_to_string(list_transform(string_split(feature, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS display FROM edges)"""

QUERY_ROWS = """,
asked AS (SELECT query_id, feature FROM (
            SELECT l_suppkey AS query_id, p_name AS feature,
                   row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) AS r
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 3),
matched AS (SELECT query_id, entity_id, feature, w FROM asked JOIN edges USING (feature) WHERE w >= 0.3),
totals AS (SELECT query_id, entity_id, sum(w) AS score, count(*) AS n, list_sort(list(feature)) AS fs FROM matched GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, n DESC, entity_id) AS rank FROM totals)"""

EARLY = """
early_graph AS (WITH bag AS (SELECT o_custkey AS entity_id, p_name AS feature
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE o_orderdate < '1997-01-01'),""" + COMBINED[COMBINED.index("counts AS"):] + f"""
 SELECT entity_id, 'symptom::' || replace(feature, ' ', '_') AS feature_id, w, tfidf, conf, category FROM weighted WHERE w >= {MIN_WEIGHT}),
"""

NORMALISED = """
items AS (SELECT doc_id, source, trim(unnest(string_split(text, ',')), E' \\n\\t\\r') AS item FROM documents),
low AS (SELECT doc_id, source, trim(regexp_replace(lower(item), '\\s+', ' ', 'g')) AS t FROM items WHERE item <> ''),
words AS (SELECT doc_id, source, t, string_split(t, ' ') AS ws FROM low),
stripped AS (SELECT doc_id, source, CASE WHEN len(ws) <= 2 THEN t ELSE array_to_string(list_filter(ws,
    lambda x: x NOT IN ('and','or','of','the','a','an','in','on','at','to','for','with')), ' ') END AS t FROM words)"""


def _phrase_sql() -> str:
    out = "t"
    for old, new in tx.PHRASES:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


QUERIES = {
    "pair_frequency": (pair_frequency, f"WITH {PAIRS} SELECT entity_id, feature, round(freq + 1e-9, 6) AS frequency_weight FROM plain"),
    "pair_tfidf": (pair_tfidf, f"""WITH {PAIRS} SELECT entity_id, feature, round(freq + 1e-9, 6) AS tf_normalized,
        round(idf + 1e-9, 6) AS idf, round(tfidf + 1e-9, 6) AS tfidf_weight FROM plain"""),
    "pair_pmi": (pair_pmi, f"WITH {PAIRS} SELECT entity_id, feature, round(pmi + 1e-9, 6) AS pmi_raw, round(ppmi + 1e-9, 6) AS pmi_weight FROM plain"),
    "pair_combined": (pair_combined, f"""WITH {COMBINED} SELECT entity_id, feature, round(tfidf + 1e-9, 6) AS tfidf_weight,
        round(norm + 1e-9, 6) AS tfidf_normalized, round(ppmi + 1e-9, 6) AS pmi_weight, round(conf + 1e-9, 6) AS pmi_confidence,
        round(w + 1e-9, 6) AS final_weight, category AS weight_category FROM weighted"""),
    "plain_weights": (plain_weights, f"""WITH {PAIRS} SELECT entity_id, feature, round(freq + 1e-9, 6) AS frequency_weight,
        round(tfidf + 1e-9, 6) AS tfidf_weight, round(ppmi + 1e-9, 6) AS pmi_weight FROM plain"""),
    "weight_union": (weight_union, f"""WITH {PAIRS} SELECT entity_id, feature, round(freq + 1e-9, 6) AS frequency_weight,
        round(tfidf + 1e-9, 6) AS tfidf_weight, round(ppmi + 1e-9, 6) AS pmi_weight FROM plain"""),
    "weight_minmax": (weight_minmax, f"""WITH {PAIRS}, lim AS (SELECT min(freq) f0, max(freq) f1, min(tfidf) t0, max(tfidf) t1,
          min(ppmi) p0, max(ppmi) p1 FROM plain),
        norm AS (SELECT entity_id, feature, CASE WHEN f1 > f0 THEN (freq - f0) / (f1 - f0) ELSE 0.5 END AS f,
          CASE WHEN t1 > t0 THEN (tfidf - t0) / (t1 - t0) ELSE 0.5 END AS t,
          CASE WHEN p1 > p0 THEN (ppmi - p0) / (p1 - p0) ELSE 0.5 END AS p FROM plain, lim)
        SELECT entity_id, feature, round(f + 1e-9, 6) AS frequency_weight_norm, round(t + 1e-9, 6) AS tfidf_weight_norm,
          round(p + 1e-9, 6) AS pmi_weight_norm, round(least(1, greatest(0, 0.2 * f + 0.5 * t + 0.3 * p)) + 1e-9, 6) AS combined_weight FROM norm"""),
    "top_features": (top_features, f"""WITH {COMBINED} SELECT * FROM (SELECT entity_id, feature, round(w + 1e-9, 6) AS final_weight,
        category AS weight_category, row_number() OVER (PARTITION BY entity_id ORDER BY round(w + 1e-9, 6) DESC, feature) AS rank
        FROM weighted) WHERE rank <= 10"""),
    "pair_distinct_counts": (pair_distinct_counts, f"""WITH {PAIRS} SELECT count(*) AS pairs, count(DISTINCT entity_id) AS entities,
        count(DISTINCT feature) AS features FROM counts"""),
    "symptom_pairs_from_text": (symptom_pairs_from_text, f"""WITH {NORMALISED}
        SELECT DISTINCT doc_id AS entity_id, lower(source) AS entity, f AS feature, 'symptom::' ||
          coalesce(nullif(trim(regexp_replace(lower(f), '[^a-z0-9]+', '_', 'g'), '_'), ''),
                   'symptom_' || ('0x' || substr(md5(f), 1, 15))::BIGINT) AS feature_id
        FROM (SELECT doc_id, source, {_phrase_sql()} AS f FROM stripped) WHERE length(f) > 1"""),
    "pair_bag_from_text": (pair_bag_from_text, f"""WITH {NORMALISED} SELECT doc_id AS entity_id, count(*) AS items,
        count(DISTINCT item) AS distinct_items, sum(length(item))::BIGINT AS chars FROM items WHERE item <> '' GROUP BY ALL"""),
    "graph_stats": (graph_stats, f"""WITH {GRAPH}, c AS (SELECT (SELECT count(*) FROM entities) AS e,
          (SELECT count(*) FROM features) AS f, (SELECT count(*) FROM edges) AS r)
        SELECT unnest(['entities', 'features', 'has_feature', 'indicates', 'total_nodes', 'total_relationships']) AS metric,
               unnest([e, f, r, r, e + f, 2 * r]) AS value FROM c"""),
    "graph_edges": (graph_edges, f"""WITH {GRAPH} SELECT entity_id, feature_id, round(w + 1e-9, 6) AS weight,
        round(tfidf + 1e-9, 6) AS tfidf_weight, round(conf + 1e-9, 6) AS pmi_confidence, category FROM edges"""),
    "graph_upsert": (graph_upsert, f"""WITH {EARLY} {GRAPH} SELECT coalesce(e.entity_id, s.entity_id) AS entity_id,
        coalesce(e.feature_id, s.feature_id) AS feature_id,
        round(CASE WHEN e.entity_id IS NULL THEN s.w ELSE e.w END + 1e-9, 6) AS weight,
        round(CASE WHEN e.entity_id IS NULL THEN s.tfidf ELSE e.tfidf END + 1e-9, 6) AS tfidf_weight,
        round(CASE WHEN e.entity_id IS NULL THEN s.conf ELSE e.conf END + 1e-9, 6) AS pmi_confidence,
        CASE WHEN e.entity_id IS NULL THEN s.category ELSE e.category END AS category
        FROM early_graph s FULL JOIN edges e ON s.entity_id = e.entity_id AND s.feature_id = e.feature_id"""),
    "graph_merge": (graph_merge, f"""WITH {EARLY} {GRAPH}, merged AS (SELECT coalesce(e.entity_id, s.entity_id) AS entity_id,
          coalesce(e.feature_id, s.feature_id) AS feature_id, CASE WHEN e.entity_id IS NULL THEN s.w ELSE e.w END AS w, e.entity_id IS NULL AS old
          FROM early_graph s FULL JOIN edges e ON s.entity_id = e.entity_id AND s.feature_id = e.feature_id)
        SELECT 'edge' AS kind, entity_id::VARCHAR AS source_id, feature_id AS target_id, round(w + 1e-9, 6) AS weight,
          CASE WHEN old THEN '1997-01-01' ELSE '1999-01-01' END AS updated FROM merged
        UNION ALL SELECT DISTINCT 'entity', entity_id::VARCHAR, '', NULL, NULL FROM merged
        UNION ALL SELECT DISTINCT 'feature', feature_id, '', NULL, NULL FROM merged"""),
    "entity_search": (entity_search, f"WITH {GRAPH} SELECT DISTINCT display AS display_name FROM features WHERE contains(name, 'widget')"),
    "entity_search_by_name": (entity_search_by_name, f"""WITH {GRAPH} SELECT entity_id, display AS display_name FROM entities
        WHERE contains(name, 'customer#00000001')"""),
    "entity_validate": (entity_validate, f"""WITH {GRAPH},
        req AS (SELECT DISTINCT upper(p_name) AS name, CASE WHEN p_size > 25 THEN 'Disease' END AS type FROM part)
        SELECT r.name, r.type, f.feature_id IS NOT NULL AND r.type IS NULL AS valid,
          CASE WHEN r.type IS NULL THEN f.feature_id END AS entity_id, CASE WHEN r.type IS NULL THEN f.name END AS entity_name,
          CASE WHEN r.type IS NULL THEN f.display END AS display_name,
          CASE WHEN r.type IS NULL AND f.feature_id IS NOT NULL THEN 'Symptom' END AS entity_type
        FROM req r LEFT JOIN features f ON lower(r.name) = f.name"""),
    "rank_entities_by_features": (rank_entities_by_features, f"""WITH {GRAPH} {QUERY_ROWS}
        SELECT query_id, rank, entity_id, display AS entity_name, round(score + 1e-9, 4) AS total_score, n AS matched_count,
          array_to_string(fs, ',') AS matched_features FROM ranked JOIN entities USING (entity_id) WHERE rank <= 10"""),
    "related_with_additional": (related_with_additional, f"""WITH {GRAPH} {QUERY_ROWS},
        best AS (SELECT * FROM ranked WHERE rank <= 10),
        more AS (SELECT query_id, entity_id, display, w FROM best JOIN edges e USING (entity_id) JOIN features f ON f.feature_id = e.feature_id
                 WHERE w >= 0.3 AND (query_id, e.feature) NOT IN (SELECT (query_id, feature) FROM asked))
        SELECT query_id, rank, entity_id, round(score + 1e-9, 4) AS total_score, n AS matched_count,
          display AS additional_feature, round(more.w + 1e-9, 4) AS additional_weight
        FROM best LEFT JOIN more USING (query_id, entity_id)"""),
    "suggestions": (suggestions, None),
    "features_of_entity": (features_of_entity, f"""WITH {GRAPH} SELECT entity_id, en.display AS entity_name, f.display AS feature,
        round(w + 1e-9, 6) AS weight, category FROM edges e JOIN entities en USING (entity_id) JOIN features f ON f.feature_id = e.feature_id
        WHERE w >= 0.3 AND lower(en.display) = 'customer#000000007'"""),
    "concept_relationships": (concept_relationships, f"""WITH {GRAPH}, rel AS (
          SELECT entity_id::VARCHAR AS concept_id, 'DISEASE' AS concept_type, e.feature AS related, w FROM edges e
          UNION ALL SELECT e.feature, 'SYMPTOM', en.name, w FROM edges e JOIN entities en USING (entity_id))
        SELECT concept_id, concept_type, count(*) AS neighbours, round(sum(w) + 1e-9, 4) AS weight_sum, min(related) AS first_related,
          'Medical ' || lower(concept_type) || ': ' || concept_id AS definition FROM rel GROUP BY ALL"""),
    "relations": (relations, f"""WITH {GRAPH} SELECT entity_id, en.name AS entity, e.feature_id, f.name AS feature, f.display AS feature_name,
        round(w + 1e-9, 6) AS weight, round(tfidf + 1e-9, 6) AS tfidf_weight, round(conf + 1e-9, 6) AS pmi_confidence
        FROM edges e JOIN entities en USING (entity_id) JOIN features f ON f.feature_id = e.feature_id WHERE w >= 0.4"""),
}
