"""Fusion of scored evidence from several sources.

Evidence rows: ``query_id, seq, source_type, entity, p, confidence, uncertainty``; confidence and
uncertainty repeat on every row of a source. Everything is a partial aggregate over (query, entity)
or (query, source); the small reliability table is joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.numeric import clamp, ratio
from evigraph.schemas import schema

# Fixed values that results depend on.
SOURCE_WEIGHTS = {"neural": 0.4, "symbolic": 0.3, "rag": 0.2, "context": 0.1}
RELIABILITY = [
    ("neural", 0.85, 0.82, 0.88, 0.75),
    ("symbolic", 0.78, 0.89, 0.72, 0.90),
    ("rag", 0.70, 0.75, 0.68, 0.65),
    ("context", 0.60, 0.65, 0.58, 0.60),
]
MIN_SOURCE_WEIGHT = 0.1
UNKNOWN_BASE_WEIGHT = 0.25
UNKNOWN_ACCURACY = UNKNOWN_CALIBRATION_WEIGHT = 0.7
UNKNOWN_CALIBRATION_FACTOR = 1.0
UNKNOWN_CALIBRATION_QUALITY = 0.5
LEARNING_RATE = 0.1
# Consecutive batch numbers whose updates are composed first.
BATCH_BLOCK = 1024


def default_reliability(spark: SparkSession) -> DataFrame:
    # built from literals inside the JVM: no Python worker behind a four-row table
    names = schema("reliability").names
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in RELIABILITY])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _base_weight() -> Column:
    out = F.lit(UNKNOWN_BASE_WEIGHT)
    for name, w in SOURCE_WEIGHTS.items():
        out = F.when(F.col("source_type") == name, F.lit(w)).otherwise(out)
    return out


def sources(evidence: DataFrame, reliability: DataFrame) -> DataFrame:
    """One row per (query, source) with its dynamic weight, normalised within the query."""
    per = evidence.groupBy("query_id", "source_type").agg(
        F.max("confidence").alias("confidence"), F.max("uncertainty").alias("uncertainty"),
        F.count(F.lit(1)).alias("predictions"), F.min("seq").alias("seq"),
    ).join(reliability.select("source_type", "accuracy", "calibration"), "source_type", "left")
    trust = 0.4 * F.coalesce("accuracy", F.lit(UNKNOWN_ACCURACY)) + 0.6 * F.coalesce("calibration", F.lit(UNKNOWN_CALIBRATION_WEIGHT))
    raw = _base_weight() * F.col("confidence") * F.greatest(F.lit(0.1), 1 - F.col("uncertainty")) * trust
    per = per.withColumn("_raw", F.greatest(F.lit(MIN_SOURCE_WEIGHT), raw))
    total = per.groupBy("query_id").agg(F.sum("_raw").alias("_total"))
    return per.join(total, "query_id").select(
        "query_id", "source_type", "seq", "confidence", "uncertainty", "predictions", "calibration",
        (F.col("_raw") / F.col("_total")).alias("weight"),
    )


def _weighted_rows(evidence: DataFrame, src: DataFrame) -> DataFrame:
    return evidence.select("query_id", "source_type", "entity", "p").join(
        src.select("query_id", "source_type", "uncertainty", "weight", "calibration", "seq"), ["query_id", "source_type"]
    )


def fuse_weighted(evidence: DataFrame, src: DataFrame) -> DataFrame:
    """Weighted means per entity, then calibration towards 0.5."""
    fused = _weighted_rows(evidence, src).groupBy("query_id", "entity").agg(
        ratio(F.sum(F.col("weight") * F.col("p")), F.sum("weight")).alias("_c"),
        ratio(F.sum(F.col("weight") * F.col("uncertainty")), F.sum("weight")).alias("uncertainty"),
        F.avg(F.coalesce("calibration", F.lit(UNKNOWN_CALIBRATION_FACTOR))).alias("_cal"),
        F.count(F.lit(1)).alias("source_count"),
    )
    calibrated = clamp(F.col("_c") * F.col("_cal") + (1 - F.col("_cal")) * 0.5, 0.0, 1.0)
    return fused.select("query_id", "entity", calibrated.alias("confidence"), "uncertainty", "source_count")


def fuse_bayesian(evidence: DataFrame, src: DataFrame) -> DataFrame:
    """Posterior from prior 0.5 and one likelihood per source: the product of odds."""
    p = clamp(F.col("p"), 1e-12, 1 - 1e-12)
    return _weighted_rows(evidence, src).groupBy("query_id", "entity").agg(
        (1 / (1 + F.exp(-F.sum(F.log(p / (1 - p)))))).alias("confidence"),
        F.avg(F.col("uncertainty") * F.col("weight")).alias("uncertainty"),
        F.count(F.lit(1)).alias("source_count"),
    )


def fuse(evidence: DataFrame, reliability: DataFrame, method: str = "weighted_average") -> DataFrame:
    """Fused entity scores; an unknown method falls back to the weighted average."""
    src = sources(evidence, reliability)
    return fuse_bayesian(evidence, src) if method == "bayesian" else fuse_weighted(evidence, src)


def overall(fused: DataFrame, src: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Overall confidence and uncertainty and calibration quality; queries without evidence get 0 / 1 / 0."""
    f = fused.groupBy("query_id").agg(F.avg("confidence").alias("_pc"), F.avg("uncertainty").alias("_pu"))
    s = src.groupBy("query_id").agg(
        F.avg("confidence").alias("_sc"), F.avg("uncertainty").alias("_su"), F.count(F.lit(1)).alias("n_sources"),
        F.avg(F.coalesce("calibration", F.lit(UNKNOWN_CALIBRATION_QUALITY)) * F.col("confidence")).alias("calibration_quality"),
    )
    n = F.col("n_sources")
    c = clamp(0.7 * F.col("_pc") + 0.3 * F.col("_sc") + F.least(F.lit(0.1), n * 0.02), 0.0, 1.0)
    u = clamp((0.6 * F.col("_pu") + 0.4 * F.col("_su")) * F.when(n > 1, 1 / F.sqrt(n)).otherwise(1.0), 0.0, 1.0)
    out = f.join(s, "query_id").select("query_id", c.alias("overall_confidence"), u.alias("overall_uncertainty"), "n_sources", "calibration_quality")
    if queries is None:
        return out
    return queries.select("query_id").distinct().join(out, "query_id", "left").select(
        "query_id", F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
        F.coalesce("overall_uncertainty", F.lit(1.0)).alias("overall_uncertainty"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("calibration_quality", F.lit(0.0)).alias("calibration_quality"),
    )


def reasoning_chain(src: DataFrame, method: str = "weighted_average") -> DataFrame:
    """Steps of the fusion per query, one per source in order (at most one row per source type)."""
    line = F.format_string("%s: %d predictions, confidence=%.3f, weight=%.3f", F.initcap("source_type"), F.col("predictions"),
                           F.col("confidence"), F.col("weight"))
    per = src.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_type", line.alias("line")))), lambda x: x["line"]).alias("_l")
    )
    head = F.format_string(f"{method} over %d sources", F.size("_l"))
    tail = F.array(F.lit("weights follow source reliability and confidence"), F.lit("scores calibrated by past performance"))
    return per.select("query_id", F.concat(F.array(head), "_l", tail).alias("steps"))


def duplicated_sources(evidence_sources: DataFrame) -> DataFrame:
    """Query and source type pairs given more than once in a table of one row per source (an input error)."""
    return evidence_sources.groupBy("query_id", "source_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def evidence_rows(entities: DataFrame, graph: DataFrame, documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evidence from the four stages of answering a query.

    entities ``query_id, concept_name, confidence_score``; graph ``query_id, entity, total_score``;
    documents ``query_id``; predictions ``query_id, entity, probability`` (optional ``uncertainty``).
    """

    def stage(df: DataFrame, seq: int, kind: str, entity: Column, p: Column, uncertainty: Column) -> DataFrame:
        rows = df.groupBy("query_id", entity.alias("entity")).agg(F.max(p).alias("p"), F.avg(uncertainty).alias("_u"))
        per = rows.groupBy("query_id").agg(F.avg("p").alias("confidence"), F.avg("_u").alias("uncertainty"))
        return rows.drop("_u").join(per, "query_id").select(
            "query_id", F.lit(seq).alias("seq"), F.lit(kind).alias("source_type"), "entity", "p", "confidence", "uncertainty")

    hits = documents.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ns_u = F.col("uncertainty") if "uncertainty" in predictions.columns else F.lit(0.5)
    parts = [
        stage(entities, 0, "neural", F.col("concept_name"), F.col("confidence_score"), F.lit(0.3)),
        stage(graph, 1, "symbolic", F.col("entity"), F.least(F.lit(1.0), F.col("total_score") / 5.0), F.lit(0.2)),
        stage(hits, 2, "rag", F.lit("document_relevance"), F.least(F.lit(1.0), F.col("n") * 0.2), F.lit(0.4)),
        stage(predictions, 3, "neuro_symbolic", F.col("entity"), F.col("probability"), ns_u),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def simple_confidence(entities: DataFrame, predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean of entity and prediction confidences and mean prediction uncertainty, 0.5 by default."""
    both = entities.select("query_id", F.col("confidence_score").alias("c")).unionByName(
        predictions.select("query_id", F.col("confidence").alias("c")))
    c = both.groupBy("query_id").agg(F.avg("c").alias("confidence"))
    u = predictions.groupBy("query_id").agg(F.avg("uncertainty").alias("uncertainty"))
    return queries.select("query_id").join(c, "query_id", "left").join(u, "query_id", "left").select(
        "query_id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("uncertainty", F.lit(0.5)).alias("uncertainty"))


def feedback_confusion(feedback: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per source and batch at threshold 0.5, with the batch's accuracy, precision, recall."""
    said, true = F.col("p") > 0.5, F.col("truth")
    count = lambda c: F.sum(c.cast("bigint"))
    per = feedback.groupBy("source_type", "batch").agg(
        count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"), count(~said & ~true).alias("tn"))
    return (
        per.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
        .withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    )


def update_reliability(reliability: DataFrame, feedback: DataFrame, alpha: float = LEARNING_RATE, block: int = BATCH_BLOCK) -> DataFrame:
    """Moving average over ordered batches as a scan of affine maps.

    A batch moves x to (1 - alpha) x + alpha v. The batches of a block of ``block`` consecutive numbers
    compose to one map x -> (1 - alpha)^n x + shift, and the blocks' maps are applied in order by the
    number of batches after each. A window holds one block of a source, or one row per block.
    """
    per = feedback_confusion(feedback).where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") > 0)
    from pyspark.sql import Window

    measures = ("accuracy", "precision", "recall")
    decay = lambda n: F.pow(F.lit(1 - alpha), n)
    later = Window.partitionBy("source_type", "_block").orderBy(F.desc("batch"))
    weighted = per.withColumn("_block", F.floor(F.col("batch") / block)).withColumn("_w", F.lit(alpha) * decay(F.row_number().over(later) - 1))
    maps = weighted.groupBy("source_type", "_block").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_w") * F.col(c)).alias(f"_{c}") for c in measures])
    following = Window.partitionBy("source_type").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    placed = maps.withColumn("_after", F.coalesce(F.sum("_n").over(following), F.lit(0)))
    sums = placed.groupBy("source_type").agg(
        F.sum("_n").alias("batches"), *[F.sum(decay(F.col("_after")) * F.col(f"_{c}")).alias(f"_{c}") for c in measures])
    joined = reliability.join(sums, "source_type", "full")
    keep = F.pow(F.lit(1 - alpha), F.coalesce("batches", F.lit(0)))
    moved = lambda c: (keep * F.coalesce(c, F.lit(0.5)) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c)
    return joined.select("source_type", moved("accuracy"), moved("precision"), moved("recall"),
                         F.coalesce("calibration", F.lit(0.5)).alias("calibration"), F.coalesce("batches", F.lit(0)).alias("batches"))
