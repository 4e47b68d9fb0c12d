"""Answering a table of questions: link, retrieve, rank, predict, fuse, assess.

Every stage is keyed by ``query_id`` and left-joined back, so a question without results in one
stage goes on with empty values instead of failing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import conversation as cv
from evigraph.operators import fusion as fu
from evigraph.operators import graph as gr
from evigraph.operators import linking as ln
from evigraph.operators import predict as pr
from evigraph.operators import retrieval as rt
from evigraph.operators import safety as sf
from evigraph.session import cut_lineage


@dataclass(frozen=True)
class Knowledge:
    """Tables the stages read: dictionary, graph, chunk store and reliability."""

    names: DataFrame
    entities: DataFrame
    features: DataFrame
    edges: DataFrame
    chunks: DataFrame
    reliability: DataFrame


def answer(queries: DataFrame, know: Knowledge, method: str = "weighted_average", min_weight: float = 0.3, top_n: int = 10,
           history: DataFrame | None = None) -> DataFrame:
    """Questions ``query_id, text`` with response, confidence, uncertainty, risk and flags.

    Questions may carry ``collections`` and ``wanted`` (metadata such as the patient), which restrict the
    documents of that question. With ``history`` (messages ``conv_id, turn, role, text``) they carry
    ``conv_id, turn`` and the result has a ``prompt`` from the three turns before the question.
    A question that is null or blank comes back as an error row (confidence 0, uncertainty 1).
    """
    valid = F.trim(F.coalesce("text", F.lit(""))) != ""
    asked = queries.where(valid)
    linked = cut_lineage(ln.link_documents(asked.select(F.col("query_id").alias("doc_id"), "text"), know.names).withColumnRenamed("doc_id", "query_id"))
    # stages below are read several times each, so their small results are written once
    symptoms = linked.where(F.col("concept_type") == "SYMPTOM").select("query_id", F.col("concept_name").alias("feature"))
    found = cut_lineage(rt.retrieve(asked, know.chunks).select("query_id", "rank", "chunk_id"))
    ranked = gr.rank_entities(symptoms, know.entities, know.features, know.edges, min_weight, top_n)
    labels = pr.label_vocabulary(know.entities.select(F.col("id").alias("entity_id")))
    predicted = pr.predict_top_k(
        symptoms.select(F.col("query_id").alias("case_id"), tx.slug_id(F.col("feature")).alias("feature_id")),
        know.edges.select("entity_id", "feature_id", "weight"), labels)
    shown = know.entities.select(F.col("id").alias("entity_id"), F.col("display_name").alias("entity"))
    evidence = cut_lineage(fu.evidence_rows(
        linked.select("query_id", "concept_name", "confidence_score"),
        ranked.select("query_id", F.col("entity_name").alias("entity"), "total_score"),
        found.select("query_id"),
        predicted.join(shown, "entity_id").select(F.col("case_id").alias("query_id"), "entity", "probability"),
    ))
    src = cut_lineage(fu.sources(evidence, know.reliability))
    fused = cut_lineage(fu.fuse_bayesian(evidence, src) if method == "bayesian" else fu.fuse_weighted(evidence, src))
    overall = fu.overall(fused, src, asked)
    text = cv.response_parts(linked, fused, overall, found, asked)
    text = text if history is None else cut_lineage(text)
    # a question's own entities: as many as its text can hold
    mentions = linked.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("concept_name", "concept_type"))).alias("entities"))
    none = F.array().cast("array<struct<concept_name:string,concept_type:string>>")
    rows = (
        text.join(overall, "query_id").join(mentions, "query_id", "left")
        .join(sf.contradictions(fused.select("query_id", "confidence")), "query_id", "left")
        .join(fused.groupBy("query_id").agg(F.lit(True).alias("has_predictions")), "query_id", "left")
        .select("query_id", "response", F.coalesce("entities", none).alias("entities"), F.col("overall_confidence").alias("confidence"),
                F.col("overall_uncertainty").alias("uncertainty"), "contradictory", "has_predictions", "documents", "n_sources")
    )
    safe = sf.sanitize(sf.assess(rows)).join(fu.reasoning_chain(src, method), "query_id", "left")
    good = safe.select(
        "query_id", F.col("sanitized").alias("response"), "confidence", "uncertainty", "risk_level", "flags", "human_review_required",
        "confidence_override", F.size("entities").alias("entities"), "documents", "n_sources",
        F.concat(
            F.array(F.format_string("%d entities recognised", F.size("entities"))),
            F.coalesce("steps", F.array().cast("array<string>")),
            F.array(F.format_string("risk %s, %d flags", "risk_level", F.size("flags"))),
        ).alias("reasoning"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = queries.where(~valid).select(
        "query_id", F.lit("This question could not be processed.").alias("response"), F.lit(0.0).alias("confidence"), F.lit(1.0).alias("uncertainty"),
        F.lit("moderate").alias("risk_level"), F.array().cast("array<string>").alias("flags"), F.lit(False).alias("human_review_required"),
        F.lit(None).cast("double").alias("confidence_override"), F.lit(0).alias("entities"), F.lit(0).cast("bigint").alias("documents"),
        F.lit(0).cast("bigint").alias("n_sources"), F.array(F.lit("processing failed")).alias("reasoning"), F.lit("empty question").alias("error"))
    if history is None:
        return good.unionByName(bad)
    prompts = cv.prompt_parts(asked, history, text)
    return good.join(prompts, "query_id", "left").unionByName(bad, allowMissingColumns=True)
