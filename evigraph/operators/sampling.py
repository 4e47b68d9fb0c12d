"""Splits with exact quotas and simulated encounters.

All randomness is a hash of keys and a seed, so a retried task or another partitioning draws the
same sample. Quota cuts are order statistics of the hash found by distributed selection; rows whose
60-bit hashes tie at a cut fall on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.numeric import hash60, uniform
from evigraph.functions.ordered import attach_scalars, exact_ranks, top_per_group


def _label(value: Column, cuts: list[tuple[str, str]], last: str) -> Column:
    out = F.lit(last)
    for name, cut in reversed(cuts):
        out = F.when(F.col(cut).isNotNull() & (value <= F.col(cut)), name).otherwise(out)
    return out


def split_exact(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``: the int(n * (1 - test_fraction)) rows of smallest hash are train."""
    rows = df.withColumn("_h", hash60(F.lit(seed), F.col(id_col)))
    cuts = exact_ranks(rows, [], "_h", {"_cut": lambda n: F.floor(n * F.lit(1 - test_fraction) + 1e-9) - 1})
    return attach_scalars(rows, cuts.select("_cut")).withColumn("part", _label(F.col("_h"), [("train", "_cut")], "test")).drop("_h", "_cut")


def split_stratified(df: DataFrame, id_col: str, label_col: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``part`` with the same shares inside every label; one label may hold most rows. Null is a label."""
    label = F.when(F.col(label_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(label_col).cast("string")))
    rows = df.withColumn("_h", hash60(F.lit(seed), F.col(id_col))).withColumn("_label", label)
    cuts = exact_ranks(rows, ["_label"], "_h", {
        "_a": lambda n: F.floor(n * F.lit(1 - val - test) + 1e-9) - 1,
        "_b": lambda n: F.floor(n * F.lit(1 - test) + 1e-9) - 1,
    }).drop("n")
    return rows.join(cuts, "_label", "left").withColumn(
        "part", _label(F.col("_h"), [("train", "_a"), ("val", "_b")], "test")).drop("_h", "_a", "_b", "_label")


def split_leading(df: DataFrame, order_col: str, fraction: float = 0.8) -> DataFrame:
    """Adds ``part``: the leading share in the order of a unique numeric column is train."""
    cuts = exact_ranks(df, [], order_col, {"_cut": lambda n: F.floor(n * F.lit(fraction) + 1e-9) - 1})
    return attach_scalars(df, cuts.select("_cut")).withColumn("part", _label(F.col(order_col), [("train", "_cut")], "val")).drop("_cut")


def simulate_encounters(
    relations: DataFrame, samples_per_entity: int = 70, drop_p: float = 0.15, noise_p: float = 0.1, seed: int = 42
) -> DataFrame:
    """Simulated cases in long form: ``encounter_id, entity_id, idx, feature_id, polarity``.

    Each feature is kept with probability min(0.95, 1.5 * weight); under two kept, the three
    heaviest are used; kept ones are dropped with ``drop_p``; under two left, a fixed sample of two
    is used; features of the same entity that are not positive become negative with ``noise_p``.
    Counts per case are partial aggregates; the fallback features are ranked once per entity.
    """
    base = relations.select("entity_id", "feature_id", "weight").distinct()
    heavy = top_per_group(base, ["entity_id"], [F.desc("weight"), F.asc("feature_id")], 3).select(
        "entity_id", "feature_id", F.lit(True).alias("_heavy"))
    sampled = top_per_group(
        base.withColumn("_s", hash60(F.lit(seed), F.lit("sample"), F.col("entity_id"), F.col("feature_id"))),
        ["entity_id"], [F.asc("_s"), F.asc("feature_id")], 2).select("entity_id", "feature_id", F.lit(True).alias("_sampled"))
    marked = base.join(heavy, ["entity_id", "feature_id"], "left").join(sampled, ["entity_id", "feature_id"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("_heavy", "_sampled")})
    rows = marked.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(samples_per_entity - 1))))
    draw = lambda stage: uniform(F.lit(seed), F.lit(stage), F.col("entity_id"), F.col("idx"), F.col("feature_id"))
    rows = rows.select(
        "entity_id", "feature_id", "idx", "_heavy", "_sampled",
        (draw("keep") < F.least(F.lit(0.95), F.col("weight") * 1.5)).alias("_keep"),
        (draw("drop") > drop_p).alias("_stay"), (draw("noise") < noise_p).alias("_noise"))
    count = lambda c: F.sum(c.cast("int"))
    sizes = rows.groupBy("entity_id", "idx").agg(
        count(F.col("_keep")).alias("_n1"), count(F.col("_keep") & F.col("_stay")).alias("_nk"),
        count(F.col("_heavy") & F.col("_stay")).alias("_nh"))
    first = F.when(F.col("_n1") < 2, F.col("_heavy")).otherwise(F.col("_keep"))
    left = F.when(F.col("_n1") < 2, F.col("_nh")).otherwise(F.col("_nk"))
    positive = F.when(left < 2, F.col("_sampled")).otherwise(first & F.col("_stay"))
    out = rows.join(sizes, ["entity_id", "idx"]).withColumn("_p", positive)
    return out.where(F.col("_p") | F.col("_noise")).select(
        F.format_string("%s_%04d", F.col("entity_id").cast("string"), "idx").alias("encounter_id"), "entity_id", "idx", "feature_id",
        F.when(F.col("_p"), "positive").otherwise("negative").alias("polarity"))


def simple_encounters(relations: DataFrame, samples_per_entity: int = 50, max_features: int = 5, seed: int = 42) -> DataFrame:
    """Cases of up to five sampled features each, the first half positive, the rest negative."""
    rows = relations.select("entity_id", "feature_id").distinct().withColumn(
        "idx", F.explode(F.sequence(F.lit(0), F.lit(samples_per_entity - 1))))
    rows = rows.withColumn("_h", hash60(F.lit(seed), F.col("entity_id"), F.col("idx"), F.col("feature_id")))
    picked = top_per_group(rows, ["entity_id", "idx"], [F.asc("_h"), F.asc("feature_id")], max_features)
    sizes = picked.groupBy("entity_id", "idx").agg(F.count(F.lit(1)).alias("_n"))
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    return picked.join(sizes, ["entity_id", "idx"]).select(
        F.format_string("%s_%04d", F.col("entity_id").cast("string"), "idx").alias("encounter_id"), "entity_id", "idx", "feature_id",
        F.when(F.col("rank") <= half, "positive").otherwise("negative").alias("polarity"))


def nest_encounters(rows: DataFrame) -> DataFrame:
    """Long encounters as one row each with two feature lists (an encounter's own features)."""
    pick = lambda p: F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.col("feature_id"))))
    return rows.groupBy("encounter_id", "entity_id").agg(
        pick("positive").alias("positive_symptoms"), pick("negative").alias("negative_symptoms"))
