"""Safety assessment of generated texts: flags, risk level, messages, sanitised text.

One projection over the response table; nothing is shuffled except where per-query scores are
compared for contradictions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
DIAGNOSIS_PATTERNS = [
    r"\byou have\b.*\b(disease|condition|disorder|syndrome)\b",
    r"\bdiagnosed with\b",
    r"\byou are suffering from\b",
    r"\byour condition is\b",
    r"\byou definitely have\b",
    r"\bconfirm(ed)? diagnosis of\b",
]
TREATMENT_PATTERNS = [
    r"\btake\b.*\b(mg|medication|drug|pill|tablet)\b",
    r"\bdosage\b.*\bmg\b",
    r"\bprescrib(e|ed|ing)\b",
    r"\btreatment plan\b",
    r"\byou should take\b",
    r"\brecommended dose\b",
]
EMERGENCY_TERMS = [
    "chest_pain", "severe_chest_pain", "crushing_chest_pain",
    "difficulty_breathing", "shortness_of_breath", "severe_dyspnea",
    "loss_of_consciousness", "fainting", "syncope",
    "severe_headache", "sudden_severe_headache",
    "stroke_symptoms", "facial_drooping", "speech_difficulty",
    "severe_abdominal_pain", "acute_abdominal_pain",
    "heavy_bleeding", "severe_bleeding", "hemorrhage",
    "seizure", "convulsions",
    "severe_allergic_reaction", "anaphylaxis",
    "poisoning", "overdose",
    "severe_burns", "major_trauma",
]

# Our own wording per flag.
WARNINGS = {
    "emergency_symptoms": "Some of what is described can be urgent; call the emergency services if in doubt.",
    "low_confidence": "The analysis is not very sure of itself; ask a professional.",
    "high_uncertainty": "Several readings of the evidence are possible.",
    "diagnosis_claim": "This text reads like a diagnosis, which only a clinician can make.",
    "treatment_advice": "This text touches on treatment and does not replace advice from a clinician.",
    "contradictory_evidence": "The sources disagree; have the case looked at again.",
}
GENERAL_DISCLAIMER = "General information, not medical advice."
ENTITY_DISCLAIMER = "What is said about conditions may not fit your case."
DISCLAIMERS = {
    "emergency_symptoms": "In an emergency contact the local emergency services.",
    "high_uncertainty": "The analysis is uncertain; a professional evaluation is advised.",
}
MASK = "[removed]"


@dataclass(frozen=True)
class SafetyLimits:
    """Limits and switches of the assessment."""

    diagnosis_claim: float = 0.95
    treatment_advice: float = 0.90
    general_info: float = 0.70
    concerning_uncertainty: float = 0.5
    detect_emergencies: bool = True
    block_diagnosis_claims: bool = True
    block_treatment: bool = True
    require_disclaimers: bool = True
    human_review: bool = True
    contradiction_variance: float = 0.2


def _union(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def _pattern_hits(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in patterns])


def emergency_flag(names: Column) -> Column:
    """Any entity name equal to an emergency term, underscores read as spaces."""
    terms = F.array(*[F.lit(t.replace("_", " ")) for t in EMERGENCY_TERMS])
    return F.arrays_overlap(F.transform(names, lambda n: F.replace(F.lower(n), F.lit("_"), F.lit(" "))), terms)


def contradictions(scores: DataFrame, variance: float = 0.2) -> DataFrame:
    """Queries whose prediction confidences vary by more than the limit: ``query_id, contradictory``."""
    return scores.groupBy("query_id").agg(
        ((F.count(F.lit(1)) > 1) & (F.var_pop("confidence") > variance)).alias("contradictory"))


def assess(responses: DataFrame, limits: SafetyLimits = SafetyLimits()) -> DataFrame:
    """Responses ``response, entities, confidence, uncertainty, contradictory`` (booleans may be null)
    with flags, hit counts, blocked text, risk level, review flag, override and messages."""
    low = F.lower("response")
    c, u = F.col("confidence"), F.col("uncertainty")
    off = F.lit(False)
    diagnosis, treatment = _any(low, DIAGNOSIS_PATTERNS), _any(low, TREATMENT_PATTERNS)
    names = F.transform("entities", lambda e: e["concept_name"])
    raised = {
        "diagnosis_claim": diagnosis & (F.lit(limits.block_diagnosis_claims) | (c < limits.diagnosis_claim)),
        "treatment_advice": treatment & (F.lit(limits.block_treatment) | (c < limits.treatment_advice)),
        "low_confidence": c < limits.general_info,
        "high_uncertainty": u > limits.concerning_uncertainty,
        "emergency_symptoms": F.coalesce(emergency_flag(names), off) if limits.detect_emergencies else off,
        "contradictory_evidence": F.coalesce("contradictory", off),
    }
    blocked = [p for on, group in ((limits.block_diagnosis_claims, DIAGNOSIS_PATTERNS), (limits.block_treatment, TREATMENT_PATTERNS)) if on for p in group]
    hits = {
        "diagnosis_claim": (_pattern_hits(low, DIAGNOSIS_PATTERNS) if limits.block_diagnosis_claims else F.lit(0))
        + (diagnosis & (c < limits.diagnosis_claim)).cast("int"),
        "treatment_advice": (_pattern_hits(low, TREATMENT_PATTERNS) if limits.block_treatment else F.lit(0))
        + (treatment & (c < limits.treatment_advice)).cast("int"),
    }
    df = responses.withColumns({f"_{k}": v for k, v in raised.items()})
    on = {k: F.col(f"_{k}") for k in raised}
    present = lambda pairs: F.filter(F.array(*[F.when(on[k], F.lit(v)) for k, v in pairs]), lambda x: x.isNotNull())
    matched = (
        F.flatten(F.array(*[F.regexp_extract_all("response", F.lit("(?i)" + p), F.lit(0)) for p in blocked]))
        if blocked else F.array().cast("array<string>")
    )
    risk = (
        F.when(on["emergency_symptoms"], "critical")
        .when(on["diagnosis_claim"] | on["treatment_advice"], "high")
        .when((c < 0.5) | (u > 0.7) | on["contradictory_evidence"] | on["low_confidence"] | on["high_uncertainty"], "moderate")
        .otherwise("low")
    )
    cut = (
        F.when(on["high_uncertainty"], 0.2).otherwise(0.0) + F.when(on["contradictory_evidence"], 0.3).otherwise(0.0)
        + F.when(on["low_confidence"], 0.1).otherwise(0.0)
    )
    recommend = F.filter(
        F.array(
            F.when(on["emergency_symptoms"], F.lit("Seek medical attention now.")),
            F.when(on["low_confidence"] | on["high_uncertainty"], F.lit("Arrange an appointment for a proper evaluation.")),
            F.when(on["contradictory_evidence"], F.lit("Consider a second opinion.")),
            F.when(F.coalesce("has_predictions", off), F.lit("Discuss the listed possibilities with a clinician."))
            if "has_predictions" in responses.columns else F.lit(None).cast("string"),
        ),
        lambda x: x.isNotNull(),
    )
    disclaim = F.array().cast("array<string>")
    if limits.require_disclaimers:
        has_disease = F.coalesce(F.exists("entities", lambda e: e["concept_type"] == "DISEASE"), off)
        disclaim = F.concat(
            F.filter(F.array(F.lit(GENERAL_DISCLAIMER), F.when(has_disease, F.lit(ENTITY_DISCLAIMER))), lambda x: x.isNotNull()),
            present(DISCLAIMERS.items()),
        )
    out = (
        df.withColumn("flags", present([(k, k) for k in raised]))
        .withColumn("flag_hits", F.map_from_arrays(
            F.array(*[F.lit(k) for k in raised]),
            F.array(*[hits[k] if k in hits else on[k].cast("int") for k in raised])))
        .withColumn("blocked_content", matched)
        .withColumn("risk_level", risk)
        .withColumn("confidence_override", F.when(cut > 0, F.greatest(F.lit(0.0), c - cut)))
        .withColumn("warnings", present(WARNINGS.items()))
        .withColumn("disclaimers", disclaim)
        .withColumn("recommendations", recommend)
    )
    review = F.lit(False) if not limits.human_review else (
        F.col("risk_level").isin("critical", "high") | on["emergency_symptoms"] | on["diagnosis_claim"]
        | on["treatment_advice"] | on["contradictory_evidence"])
    return out.withColumn("human_review_required", review).drop(*[f"_{k}" for k in raised])


def sanitize(assessed: DataFrame, limits: SafetyLimits = SafetyLimits()) -> DataFrame:
    """Adds ``sanitized``: blocked passages masked, warnings before, notices and advice after the text.

    Only the pattern groups that ``limits`` blocks are masked; pass the limits of the assessment.
    """
    groups = ((limits.block_diagnosis_claims, DIAGNOSIS_PATTERNS), (limits.block_treatment, TREATMENT_PATTERNS))
    patterns = [p for on, group in groups if on for p in group]
    masked = reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + p, MASK), patterns, F.col("response"))
    masked = F.when(F.size("blocked_content") > 0, masked).otherwise(F.col("response"))
    block = lambda c, word: F.nullif(F.array_join(F.transform(c, lambda x: F.concat(F.lit(word + ": "), x)), "\n"), F.lit(""))
    return assessed.withColumn(
        "sanitized",
        F.concat_ws("\n\n", block("warnings", "WARNING"), masked, block("disclaimers", "DISCLAIMER"), block("recommendations", "RECOMMENDATION")),
    )


def threshold_warnings(confidence: Column, uncertainty: Column, minimum: float = 0.8, review: float = 0.6, high: float = 0.7) -> Column:
    """Simple warnings from the two overall figures."""
    return F.filter(
        F.array(
            F.when(confidence < minimum, F.lit("Low confidence: seek professional advice.")),
            F.when(uncertainty > review, F.lit("High uncertainty: have a person review this.")),
            F.when(uncertainty > high, F.lit("The analysis is significantly uncertain.")),
        ),
        lambda x: x.isNotNull(),
    )
