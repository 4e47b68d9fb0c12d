"""Weighted bipartite graph as two node tables and one edge table.

An edge row serves both directions; a direction is only the side a join starts from.
Nodes: ``id, name, display_name``. Edges: ``entity_id, feature_id, weight, tfidf_weight,
pmi_confidence, category``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions.ordered import bags, top_per_group
from evigraph.operators.product import best_entities, entity_rows
from evigraph.session import cut_lineage

EDGE_PROPERTIES = ["weight", "tfidf_weight", "pmi_confidence", "category"]


def build_graph(
    weights: DataFrame, names: DataFrame, min_weight: float = 0.2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, features and edges from combined weights at or above ``min_weight``.

    Two features with one slug become one node: the first name in (entity, feature) order stays,
    the last edge in that order wins. The weights kept are written once, nodes and edges read them; a
    slug is made once a feature, not once a pair.
    """
    kept = cut_lineage(weights.where(F.col("final_weight") >= min_weight).select(
        "entity_id", "feature", F.col("final_weight").alias("weight"), "tfidf_weight", "pmi_confidence",
        F.col("weight_category").alias("category"),
    ))
    slugs = cut_lineage(
        kept.groupBy("feature")
        .agg(F.min("entity_id").alias("entity_id"), F.max(F.col("entity_id").isNull()).alias("unowned"))
        .withColumn("feature_id", tx.slug_id(F.col("feature")))
    )
    # a row without an entity comes first
    order = F.struct(F.when(~F.col("unowned"), F.col("entity_id")).alias("entity_id"), "feature")
    features = (
        slugs.groupBy("feature_id").agg(F.min_by("feature", order).alias("name"))
        .select(F.col("feature_id").alias("id"), "name", tx.display_name(F.col("name")).alias("display_name"))
    )
    entities = (
        kept.select("entity_id").distinct()
        .join(names.select("entity_id", F.col("entity").alias("name")), "entity_id")
        .select(F.col("entity_id").alias("id"), "name", tx.display_name(F.col("name")).alias("display_name"))
    )
    named = kept.join(slugs.select(F.col("feature").alias("_feature"), "feature_id"), F.col("feature").eqNullSafe(F.col("_feature")))
    # hardly a row is merged before the shuffle, so rows are sorted after it only
    edges = (
        named.repartition("entity_id", "feature_id").groupBy("entity_id", "feature_id")
        .agg(F.max_by(F.struct(*EDGE_PROPERTIES), "feature").alias("e"))
        .select("entity_id", "feature_id", "e.*")
    )
    return entities, features, edges


def upsert_edges(stored: DataFrame, incoming: DataFrame, at: Column | None = None) -> DataFrame:
    """Stored edges with incoming ones added or their properties overwritten.

    With ``at`` incoming edges carry that time as ``updated_at``; other stored edges keep theirs.
    """
    keys = ["entity_id", "feature_id"]
    properties = EDGE_PROPERTIES if at is None else [*EDGE_PROPERTIES, "updated_at"]
    if at is not None:
        incoming = incoming.withColumn("updated_at", at)
    s, n = stored.alias("s"), incoming.withColumn("_new", F.lit(True)).alias("n")
    return s.join(n, keys, "full").select(
        *keys,
        *[
            F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
            for c in properties
        ],
    )


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes are created once; existing names stay."""
    return stored.unionByName(incoming.join(stored.select("id"), "id", "left_anti"))


def graph_statistics(entities: DataFrame, features: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts as ``metric, value`` rows; each edge is readable in two directions."""

    def count(df: DataFrame, *metrics: str) -> DataFrame:
        rows = F.array(*[F.lit(m) for m in metrics])
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.explode(rows).alias("metric"), "value")

    parts = count(entities, "entities").unionByName(count(features, "features"))
    parts = parts.unionByName(count(edges, "has_feature", "indicates"))
    totals = parts.groupBy(
        F.when(F.col("metric").isin("entities", "features"), F.lit("total_nodes"))
        .otherwise(F.lit("total_relationships")).alias("metric")
    ).agg(F.sum("value").alias("value"))
    return parts.unionByName(totals)


def search_entities(entities: DataFrame, pattern: str) -> DataFrame:
    """Entities whose name contains the pattern, by display name."""
    p = pattern.lower()
    return (
        entities.where(F.col("name").contains(p) | F.col("display_name").contains(p))
        .select(F.col("id").alias("entity_id"), "display_name")
        .orderBy("display_name", "entity_id")
    )


def search_features(features: DataFrame, pattern: str) -> DataFrame:
    """Distinct feature display names containing the pattern, sorted."""
    p = pattern.lower()
    return (
        features.where(F.col("name").contains(p) | F.col("display_name").contains(p))
        .select("display_name").distinct().orderBy("display_name")
    )


def list_features(features: DataFrame, n: int = 20) -> DataFrame:
    """First n stored feature ids as plain words."""
    return features.orderBy("id").limit(n).select(
        "id", F.replace(F.regexp_replace("id", "^[a-z]+::", ""), F.lit("_"), F.lit(" ")).alias("label")
    )


def validate_entities(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests ``name`` (and nullable ``type``) matched case-insensitively on name or display name.

    ``nodes`` carries ``id, name, display_name, type``. The first node by (type, id) answers.
    """
    asked = requests.select("name", "type").distinct().withColumn("_k", F.lower("name"))
    # one row per node and spelling, so the match is an equi-join rather than an OR of two
    spelled = nodes.select(
        F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("display_name")))).alias("_k"),
        F.col("id").alias("_id"), F.col("name").alias("_name"),
        F.col("display_name").alias("_display"), F.col("type").alias("_type"),
    )
    found = (
        asked.join(spelled, "_k")
        .where(F.col("type").isNull() | (F.col("type") == F.col("_type")))
        .groupBy("name", "type")
        .agg(F.min(F.struct("_type", "_id", "_name", "_display")).alias("hit"))
    )
    return (
        asked.alias("a").join(found.alias("f"), F.col("a.name").eqNullSafe(F.col("f.name")) & F.col("a.type").eqNullSafe(F.col("f.type")), "left")
        .select(
            F.col("a.name").alias("name"), F.col("a.type").alias("type"), F.col("hit").isNotNull().alias("valid"),
            F.col("hit._id").alias("entity_id"), F.col("hit._name").alias("entity_name"),
            F.col("hit._display").alias("display_name"), F.col("hit._type").alias("entity_type"),
        )
    )


def resolve_query_features(queries: DataFrame, features: DataFrame, normalise_like_store: bool = False) -> DataFrame:
    """Query rows ``query_id, feature`` to stored feature ids, by name or by slug."""
    prepare = tx.normalise_feature if normalise_like_store else tx.normalise
    asked = queries.select("query_id", prepare(F.col("feature")).alias("_name")).distinct()
    by_name = asked.join(features.select(F.col("name").alias("_name"), F.col("id").alias("feature_id")), "_name")
    by_id = asked.withColumn("feature_id", tx.slug_id(F.col("_name"))).join(
        features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi"
    )
    return by_name.select("query_id", "feature_id").unionByName(by_id.select("query_id", "feature_id")).distinct()


def rank_entities(
    queries: DataFrame, entities: DataFrame, features: DataFrame, edges: DataFrame,
    min_weight: float = 0.3, top_n: int = 10, normalise_like_store: bool = False,
) -> DataFrame:
    """Entities per query by summed edge weight, then matched count; a batch of queries is a table.

    Edges are gathered by entity and meet sets of features in the tasks that read them (:mod:`.product`); each task
    keeps ``top_n`` a set, so matches are never shuffled. Names are looked up for the best only. Queries that resolve
    to the same features have the same answer, their set is scored once.
    """
    members, wanted = bags(resolve_query_features(queries, features, normalise_like_store), "query_id", "feature_id")
    near = cut_lineage(edges.where(F.col("weight") >= min_weight).join(
        features.select(F.col("id").alias("feature_id"), F.col("name").alias("feature")), "feature_id"
    ).select("entity_id", "feature_id", "feature", "weight"))
    ranked = top_per_group(
        best_entities(wanted, entity_rows(near), top_n), ["bag_id"],
        [F.desc(F.round("total_score", 9)), F.desc("matched_count"), F.asc("entity_id")], top_n)
    # at most the query's own features
    best = (
        ranked.join(wanted, "bag_id").join(near.drop("weight"), ["entity_id", "feature_id"])
        .groupBy("bag_id", "entity_id", "rank", "total_score", "matched_count")
        .agg(F.array_sort(F.collect_list("feature")).alias("matched_features"))
        .join(members, "bag_id")
    )
    return best.join(
        entities.select(F.col("id").alias("entity_id"), F.col("display_name").alias("entity_name")), "entity_id"
    ).select("query_id", "rank", "entity_id", "entity_name", "total_score", "matched_count", "matched_features")


def related_with_additional(
    queries: DataFrame, entities: DataFrame, features: DataFrame, edges: DataFrame,
    min_weight: float = 0.3, top_n: int = 10,
) -> DataFrame:
    """Ranked entities plus one row per further feature of each; none leaves null columns."""
    # a few rows a query, read twice
    ranked = cut_lineage(rank_entities(queries, entities, features, edges, min_weight, top_n))
    asked = queries.select("query_id", tx.normalise(F.col("feature")).alias("name")).distinct()
    others = (
        ranked.select("query_id", "entity_id")
        .join(edges.where(F.col("weight") >= min_weight).select("entity_id", "feature_id", "weight"), "entity_id")
        .join(features.select(F.col("id").alias("feature_id"), "name", "display_name"), "feature_id")
        .join(asked, ["query_id", "name"], "left_anti")
        .select("query_id", "entity_id", F.col("display_name").alias("additional_feature"),
                F.col("weight").alias("additional_weight"))
    )
    return ranked.join(others, ["query_id", "entity_id"], "left")


def suggestions_json(related: DataFrame) -> DataFrame:
    """Ranked entities with their additional features as one JSON text per query and entity.

    A row holds one entity's feature list, the size the caller asked for by ``min_weight``.
    """
    keys = ["query_id", "rank", "entity_id", "entity_name", "total_score", "matched_count", "matched_features"]
    extra = F.struct(F.col("additional_weight").alias("weight"), F.col("additional_feature").alias("feature"))
    nested = related.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("additional_feature").isNotNull(), extra)), asc=False)
        .alias("additional_features")
    )
    payload = F.to_json(F.struct(*[k for k in keys if k != "query_id"], "additional_features"))
    return nested.select("query_id", "rank", payload.alias("suggestion"))


def features_of_entity(
    entities: DataFrame, features: DataFrame, edges: DataFrame,
    entity_id=None, name: str | None = None, min_weight: float = 0.3,
) -> DataFrame:
    """Features of the entities picked by id or by display name, with weight and category."""
    picked = entities
    if entity_id is not None:
        picked = picked.where(F.col("id") == F.lit(entity_id))
    if name is not None:
        picked = picked.where(F.lower("display_name") == name.lower())
    return (
        edges.where(F.col("weight") >= min_weight)
        .join(picked.select(F.col("id").alias("entity_id"), F.col("display_name").alias("entity_name")), "entity_id")
        .join(features.select(F.col("id").alias("feature_id"), F.col("display_name").alias("feature")), "feature_id")
        .select("entity_id", "entity_name", "feature", "weight", "category")
    )


def feature_list_of_entity(rows: DataFrame) -> DataFrame:
    """:func:`features_of_entity` as one nested row per entity, heaviest feature first."""
    item = F.struct((-F.col("weight")).alias("k"), F.col("feature"), F.round("weight", 4).alias("weight"), "category")
    return rows.groupBy("entity_id", "entity_name").agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda x: F.struct(x["feature"].alias("feature"), x["weight"].alias("weight"), x["category"].alias("category")),
        ).alias("features"),
        F.count(F.lit(1)).alias("feature_count"),
    )


def concept_relationships(concepts: DataFrame, entities: DataFrame, features: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of concepts ``concept_id, concept_type``: entities by id, features by name."""
    by_entity = (
        concepts.where(F.col("concept_type") == "DISEASE")
        .join(edges, F.col("concept_id") == F.col("entity_id").cast("string"))
        .join(features.select(F.col("id").alias("feature_id"), F.col("name").alias("related")), "feature_id")
    )
    by_feature = (
        concepts.where(F.col("concept_type") == "SYMPTOM")
        .join(features.select(F.col("id").alias("feature_id"), F.col("name").alias("concept_id")), "concept_id")
        .join(edges, "feature_id")
        .join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("related")), "entity_id")
    )
    cols: Sequence[str] = ["concept_id", "concept_type", "related", "weight"]
    return by_entity.select(*cols).unionByName(by_feature.select(*cols))


def fetch_relations(entities: DataFrame, features: DataFrame, edges: DataFrame, min_weight: float = 0.4) -> DataFrame:
    """Edges with names; absent TF-IDF or PMI properties fall back to the weight."""
    return (
        edges.where((F.col("weight") >= min_weight) & F.col("entity_id").isNotNull())
        .join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id")
        .join(features.select(F.col("id").alias("feature_id"), F.col("name").alias("feature"),
                              F.coalesce("display_name", "name", "id").alias("feature_name")), "feature_id")
        .select(
            "entity_id", "entity", "feature_id", "feature", "feature_name", "weight",
            F.coalesce("tfidf_weight", "weight").alias("tfidf_weight"),
            F.coalesce("pmi_confidence", "weight").alias("pmi_confidence"),
        )
    )
