"""Text expressions: normalisation, cleaning, classification, keys. All built from SQL functions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.numeric import hash60

# Fixed values that results depend on.
STOP_WORDS = ["and", "or", "of", "the", "a", "an", "in", "on", "at", "to", "for", "with"]

PHRASES = [
    ("high temperature", "fever"),
    ("elevated temperature", "fever"),
    ("high fever", "fever"),
    ("low-grade fever", "low grade fever"),
    ("mild fever", "low grade fever"),
    ("severe headache", "headache"),
    ("mild headache", "headache"),
    ("stomach pain", "abdominal pain"),
    ("belly pain", "abdominal pain"),
    ("shortness of breath", "dyspnea"),
    ("difficulty breathing", "dyspnea"),
    ("trouble breathing", "dyspnea"),
    ("weight loss", "weight loss"),
    ("loss of weight", "weight loss"),
    ("decreased appetite", "loss of appetite"),
    ("poor appetite", "loss of appetite"),
    ("reduced appetite", "loss of appetite"),
]

ABBREVIATIONS = {
    "bp": "blood pressure",
    "hr": "heart rate",
    "temp": "temperature",
    "hx": "history",
    "dx": "diagnosis",
    "tx": "treatment",
    "pt": "patient",
    "htn": "hypertension",
    "dm": "diabetes mellitus",
    "copd": "chronic obstructive pulmonary disease",
    "cad": "coronary artery disease",
    "chf": "congestive heart failure",
}

DOCUMENT_TYPE_TERMS = [
    ("clinical_notes", ["clinical note", "progress note", "consultation"]),
    ("clinical_notes", ["discharge summary", "hospital discharge"]),
    ("patient_records", ["pathology report", "lab report", "laboratory"]),
    ("disease_info", ["disease information", "medical condition", "diagnosis guide"]),
]
DEFAULT_DOCUMENT_TYPE = "clinical_notes"

PATIENT_ID_PATTERNS = [
    r"patient\s+id\s*:?\s*(\w+)",
    r"mrn\s*:?\s*(\w+)",
    r"medical\s+record\s+number\s*:?\s*(\w+)",
    r"patient\s+number\s*:?\s*(\w+)",
]

DATE_PREFIXES = [r"date\s*:?\s*", "", r"date\s+of\s+service\s*:?\s*"]

TOPIC_KEYWORDS = {
    "pain": "symptom_pain",
    "fever": "symptom_fever",
    "treatment": "treatment_discussion",
    "medication": "medication_discussion",
    "diagnosis": "diagnosis_discussion",
}

SURE_TERMS = ["clearly", "definitely", "certainly", "confirmed", "established"]
UNSURE_TERMS = ["possibly", "might", "could", "uncertain", "unclear", "may"]
HEDGE_TERMS = ["however", "although", "but", "requires further", "needs evaluation"]

NOTICE = "\n\n**Note**: general information only; please consult a healthcare professional about your own case."


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column) -> Column:
    """Lower case with single spaces."""
    return squeeze(F.lower(c))


def normalise_feature(c: Column, strict: bool = True) -> Column:
    """Normalise, drop stop words from phrases of three or more words, then map synonyms in order.

    Strict order drops stop words first, so a synonym that contains one is only reached through a
    two-word phrase. ``strict=False`` maps synonyms before and after.
    """
    text = normalise(c)
    if not strict:
        text = _map_phrases(text)
    words = F.split(text, " ")
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    text = F.when(F.size(words) <= 2, text).otherwise(F.array_join(kept, " "))
    return squeeze(_map_phrases(text) if strict else text)


def _map_phrases(c: Column) -> Column:
    return reduce(lambda acc, rule: F.replace(acc, F.lit(rule[0]), F.lit(rule[1])), PHRASES, c)


def slug_id(c: Column, prefix: str = "symptom") -> Column:
    """Readable identifier ``prefix::a_b``; text without letters or digits gets a stable hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    fallback = F.concat(F.lit(f"{prefix}_"), hash60(c).cast("string"))
    return F.concat(F.lit(f"{prefix}::"), F.when(slug == "", fallback).otherwise(slug))


def display_name(c: Column, exact: bool = True) -> Column:
    """Title case. Exact mode raises the letter after any non-letter; otherwise only after spaces."""
    if not exact:
        return F.initcap(c)
    pieces = F.split(F.lower(c), r"(?<=\P{L})")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))),
        "",
    )


def ensure_list(df: DataFrame, name: str) -> Column:
    """A list column as it is, any other as a one-item string array."""
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(F.col(name).cast("string"))


def clean_corpus_text(c: Column) -> Column:
    """Whitespace, control characters, runs of dots and dashes, missing gaps between sentences."""
    text = squeeze(c)
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "")
    text = F.regexp_replace(text, r"[.]{3,}", "...")
    text = F.regexp_replace(text, r"[-]{2,}", "--")
    text = F.regexp_replace(text, r"(?U)([.!?])\s*([A-Z])", "$1 $2")
    return F.trim(text)


def clean_document_text(c: Column) -> Column:
    """Whitespace, page marks, trailing numbers, special characters."""
    text = F.regexp_replace(c, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?iU)page \d+ of \d+", "")
    text = F.regexp_replace(text, r"(?mU)\d+\s*$", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s.,;:()/\-]", "")
    return F.trim(text)


def document_type(c: Column) -> Column:
    """First keyword rule that matches, else the default type."""
    low = F.lower(c)
    rules = [
        F.when(reduce(lambda a, b: a | b, [low.contains(t) for t in terms]), F.lit(kind))
        for kind, terms in DOCUMENT_TYPE_TERMS
    ]
    return F.coalesce(*rules, F.lit(DEFAULT_DOCUMENT_TYPE))


def patient_id(c: Column) -> Column:
    """First of four identifier patterns that matches, null when none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, "(?iU)" + p, 1), F.lit("")) for p in PATIENT_ID_PATTERNS])


def document_date(c: Column) -> Column:
    """First date a pattern yields, month first, two- or four-digit year; null when none is valid."""

    def parsed(prefix: str) -> Column:
        found = F.regexp_extract(c, r"(?i)" + prefix + r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 1)
        parts = F.split(found, "[/-]")
        year = F.get(parts, 2)
        number = year.try_cast("int")
        full = (
            F.when(F.length(year) == 4, number)
            .when((F.length(year) == 2) & (number < 69), number + 2000)
            .when(F.length(year) == 2, number + 1900)
        )
        same_mark = found.rlike(r"^\d+/\d+/\d+$|^\d+-\d+-\d+$")
        iso = F.concat_ws(
            "-",
            F.lpad(full.cast("string"), 4, "0"),
            F.lpad(F.get(parts, 0), 2, "0"),
            F.lpad(F.get(parts, 1), 2, "0"),
        )
        return F.when(same_mark & full.isNotNull(), F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))

    return F.coalesce(*[parsed(p) for p in DATE_PREFIXES])


def expand_query(c: Column) -> Column:
    """Replace known abbreviations word by word; other words keep their punctuation."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.split(normalise(c), " ")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(w, r"(?U)[^\w]", "")), w),
        ),
        " ",
    )


def contains_count(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text at least once."""
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms])


def wording_confidence(c: Column) -> Column:
    """Confidence of a text estimated from its wording, between 0.1 and 0.9."""
    low = F.lower(c)
    structured = c.contains("**Analysis:**") & c.contains("**Conclusions:**")
    referral = low.contains("consult") | low.contains("healthcare professional")
    score = (
        F.lit(0.6)
        + contains_count(low, SURE_TERMS) * 0.1
        - contains_count(low, UNSURE_TERMS) * 0.1
        - contains_count(low, HEDGE_TERMS) * 0.05
        + F.when(structured, 0.1).otherwise(0.0)
        + F.when(referral, 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), score))


def clean_generated_text(c: Column) -> Column:
    """Strip prompt tags and append a notice where the text carries none."""
    text = reduce(
        lambda acc, tag: F.replace(acc, F.lit(tag), F.lit("")),
        ["<system>", "</system>", "<user_query>", "</user_query>"],
        c,
    )
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    low = F.lower(text)
    noted = low.contains("consult") | low.contains("healthcare professional")
    return F.when(noted, text).otherwise(F.concat(text, F.lit(NOTICE)))


def reasoning_lines(c: Column) -> Column:
    """Non-blank lines between the reasoning and conclusion marks."""
    after = F.split(c, r"\*\*Clinical Reasoning:\*\*")
    body = F.split(F.get(after, 1), r"\*\*Conclusions:\*\*")
    lines = F.transform(F.split(F.get(body, 0), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    present = (F.size(after) > 1) & (F.size(body) > 1)
    return F.when(present, F.filter(lines, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def parsed_response(c: Column) -> Column:
    """Cleaned text, reasoning lines, wording confidence, word count and notice flag as one struct."""
    cleaned = clean_generated_text(c)
    low = F.lower(c)
    return F.struct(
        cleaned.alias("response"),
        reasoning_lines(c).alias("reasoning_chain"),
        wording_confidence(c).alias("confidence"),
        word_count(cleaned).alias("word_count"),
        (low.contains("disclaimer") | low.contains("consult")).alias("has_disclaimers"),
    )


def topics(query: Column, entity_types: Column | None = None) -> Column:
    """Distinct topics: lower-cased entity types, then keyword topics of the query."""
    low = F.lower(query)
    flagged = F.filter(
        F.array(*[F.when(low.contains(word), F.lit(topic)) for word, topic in TOPIC_KEYWORDS.items()]),
        lambda t: t.isNotNull(),
    )
    if entity_types is None:
        return flagged
    return F.array_distinct(F.concat(F.transform(entity_types, lambda t: F.lower(t)), flagged))


def result_key(component, c: Column, prefix: str = "medical") -> Column:
    """Reuse key: component plus 16 hex digits of SHA-256 over the normalised input."""
    component = component if isinstance(component, Column) else F.lit(component)
    digest = F.substring(F.sha2(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), 256), 1, 16)
    return F.concat_ws(":", F.lit(prefix), component, digest)


def concept_definition(concept_id: Column, concept_type: Column) -> Column:
    return F.concat(F.lit("Medical "), F.lower(concept_type), F.lit(": "), concept_id)


def cut_parts(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Parts of each text; see :func:`cut`."""
    out = []
    for text, first, last in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        out.append(None if text is None or first is None or last is None else [
            None if s is None or e is None else text[max(s, 0):max(e, 0)] for s, e in zip(first, last)])
    return pa.array(out, pa.list_(pa.string()))


def cut(text: Column, starts: Column, ends: Column) -> Column:
    """Parts of a text from each zero-based start to its end, in one pass over the row.

    A single ``substr`` counts the characters of the whole text, so many of them on a long text cost its square.
    """
    return F.arrow_udf(cut_parts, "array<string>").asNondeterministic()(text, starts, ends)


def context_left(text: Column, position: Column, window: int) -> Column:
    """Up to ``window`` characters before a zero-based position."""
    start = F.greatest(position - window, F.lit(0))
    return F.substr(text, start + 1, position - start)


def context_right(text: Column, end: Column, window: int) -> Column:
    """Up to ``window`` characters from a zero-based position on."""
    return F.substr(text, end + 1, F.lit(window))


def flatten_record(df, exclude: tuple[str, ...] = (), keys: tuple[str, ...] = ("content", "text", "message", "value")) -> Column:
    """One text from every string, string list, struct and struct list of a row, in schema order."""
    from pyspark.sql import types as T

    def texts(struct_type) -> list[str]:
        return [k for k in keys if k in struct_type.names and isinstance(struct_type[k].dataType, T.StringType)]

    def joined_texts(c: Column, inner: list[str]) -> Column:
        return F.transform(c, lambda item: F.concat_ws(" ", *[item[k] for k in inner]))

    parts: list[Column] = []
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        kind, c = field.dataType, F.col(field.name)
        if isinstance(kind, T.StringType):
            parts.append(F.nullif(c, F.lit("")))
        elif isinstance(kind, T.StructType):
            parts.extend(c[k] for k in texts(kind))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.when(F.size(c) > 0, F.array_join(c, " ")))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            inner = texts(kind.elementType)
            if inner:
                parts.append(F.when(F.size(c) > 0, F.array_join(joined_texts(c, inner), " ")))
    return F.regexp_replace(F.concat_ws(" ", *parts), r"(?U)^\s+|\s+$", "")
