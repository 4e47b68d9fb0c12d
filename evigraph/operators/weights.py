"""Association weights of (entity, feature) pairs.

All families come from one count table. The per-entity and per-feature totals are aggregates of
that table, never windows over a key, so a feature shared by a third of all pairs stays spread;
the joins back are equi-joins that adaptive execution splits when a key is hot. Totals and maxima
over the whole table enter as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.numeric import clamp, ratio
from evigraph.functions.ordered import attach_scalars, top_per_group
from evigraph.session import cut_lineage

KEYS = ["entity_id", "feature"]


def pair_counts(pairs: DataFrame, mark: str | None = None) -> DataFrame:
    """Distinct pairs with their count; with ``mark`` also ``<mark>_tf``, that of the rows where this column is true."""
    marked = [] if mark is None else [F.count_if(F.col(mark)).alias(f"{mark}_tf")]
    return pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tf"), *marked)


def with_totals(counts: DataFrame, written: bool = False) -> DataFrame:
    """Counts joined to entity totals, feature totals, document frequency and table totals.

    The counts are written once, unless they are ``written``: three aggregates and the join read them,
    and the pair table they come from would otherwise be scanned for each.
    """
    counts = counts if written else cut_lineage(counts)
    by_entity = counts.groupBy("entity_id").agg(F.sum("tf").alias("entity_total"))
    by_feature = counts.groupBy("feature").agg(
        F.sum("tf").alias("feature_total"), F.count(F.lit(1)).alias("entities_with_feature")
    )
    overall = by_entity.agg(
        F.sum("entity_total").alias("total_pairs"), F.count(F.lit(1)).alias("total_entities")
    )
    joined = counts.join(by_entity, "entity_id").join(by_feature, "feature")
    return attach_scalars(joined, overall)


def frequency_weight() -> Column:
    return F.col("tf") / F.col("entity_total")


def tfidf_weight() -> Column:
    return F.col("tf") / F.col("entity_total") * F.log(F.col("total_entities") / F.col("entities_with_feature"))


def pmi_raw() -> Column:
    joint = F.col("tf") / F.col("total_pairs")
    independent = (F.col("entity_total") / F.col("total_pairs")) * (F.col("feature_total") / F.col("total_pairs"))
    return F.log(joint / independent)


def frequency_weights(pairs: DataFrame) -> DataFrame:
    """Share of the entity's pairs that carry the feature."""
    counts = pair_counts(pairs)
    totals = counts.groupBy("entity_id").agg(F.sum("tf").alias("entity_total"))
    return counts.join(totals, "entity_id").select(*KEYS, frequency_weight().alias("frequency_weight"))


def tfidf_weights(pairs: DataFrame) -> DataFrame:
    return with_totals(pair_counts(pairs)).select(
        *KEYS,
        (F.col("tf") / F.col("entity_total")).alias("tf_normalized"),
        F.log(F.col("total_entities") / F.col("entities_with_feature")).alias("idf"),
        tfidf_weight().alias("tfidf_weight"),
    )


def pmi_weights(pairs: DataFrame) -> DataFrame:
    return with_totals(pair_counts(pairs)).select(
        *KEYS, pmi_raw().alias("pmi_raw"), F.greatest(F.lit(0.0), pmi_raw()).alias("pmi_weight")
    )


def plain_weights(pairs: DataFrame, counted: bool = False) -> DataFrame:
    """Frequency, TF-IDF and positive PMI side by side; ``counted`` pairs are written :func:`pair_counts`."""
    return with_totals(pairs if counted else pair_counts(pairs), written=counted).select(
        *KEYS,
        frequency_weight().alias("frequency_weight"),
        tfidf_weight().alias("tfidf_weight"),
        F.greatest(F.lit(0.0), pmi_raw()).alias("pmi_weight"),
    )


def merge_families(frequency: DataFrame, tfidf: DataFrame, pmi: DataFrame) -> DataFrame:
    """Union of keys of separately stored weight families; a missing weight is 0."""
    joined = frequency.join(tfidf, KEYS, "full").join(pmi, KEYS, "full")
    return joined.select(
        *KEYS,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("frequency_weight", "tfidf_weight", "pmi_weight")],
    )


def weight_category(w: Column) -> Column:
    return (
        F.when(w < 0.3, "Weak").when(w < 0.6, "Moderate").when(w < 0.8, "Strong").otherwise("Very Strong")
    )


def combined_weights(pairs: DataFrame, counted: bool = False) -> DataFrame:
    """0.7 * TF-IDF relative to its maximum + 0.3 * (1 - exp(-PPMI)), with a category.

    ``counted`` pairs are written :func:`pair_counts`.
    """
    # written once: the maximum and the scores read the same joined rows
    base = cut_lineage(plain_weights(pairs, counted).drop("frequency_weight"))
    top = base.agg(F.max("tfidf_weight").alias("tfidf_max"))
    scored = (
        attach_scalars(base, top)
        .withColumn("tfidf_normalized", ratio(F.col("tfidf_weight"), F.col("tfidf_max")))
        .withColumn("pmi_confidence", F.when(F.col("pmi_weight") > 0, 1 - F.exp(-F.col("pmi_weight"))).otherwise(0.0))
        .withColumn("final_weight", 0.7 * F.col("tfidf_normalized") + 0.3 * F.col("pmi_confidence"))
    )
    return scored.select(
        *KEYS,
        "tfidf_weight",
        "tfidf_normalized",
        "pmi_weight",
        "pmi_confidence",
        "final_weight",
        weight_category(F.col("final_weight")).alias("weight_category"),
    )


def minmax_combined(weights: DataFrame) -> DataFrame:
    """Scale each family to [0, 1] (0.5 where constant) and combine 0.2 / 0.5 / 0.3."""
    families = ("frequency_weight", "tfidf_weight", "pmi_weight")
    weights = cut_lineage(weights)
    limits = weights.agg(
        *[F.min(c).alias(f"_min_{c}") for c in families], *[F.max(c).alias(f"_max_{c}") for c in families]
    )
    df = attach_scalars(weights, limits)
    for c in families:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        df = df.withColumn(
            f"{c}_norm", F.when(high > low, F.try_divide(F.col(c) - low, high - low)).otherwise(0.5)
        )
    total = (
        0.2 * F.col("frequency_weight_norm") + 0.5 * F.col("tfidf_weight_norm") + 0.3 * F.col("pmi_weight_norm")
    )
    return df.withColumn("combined_weight", clamp(total, 0.0, 1.0)).drop(
        *[f"_{side}_{c}" for side in ("min", "max") for c in families]
    )


def top_features(weights: DataFrame, weight_col: str, n: int = 10) -> DataFrame:
    """Best n features of every entity; ties by name."""
    return top_per_group(weights, ["entity_id"], [F.desc(weight_col), F.asc("feature")], n)
