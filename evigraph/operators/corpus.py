"""Corpus preparation, statistics, annotation statistics and tables for sequence labelling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import similarity, text as tx
from evigraph.functions.numeric import ratio
from evigraph.session import once


def combine_records(df: DataFrame, id_col: str, split_col: str) -> DataFrame:
    """One text per record from all its textual fields, with its length."""
    named = df.select(
        F.concat_ws("_", F.col(split_col), F.col(id_col).cast("string")).alias("id"), F.col(split_col).alias("split"),
        F.explode(F.array(tx.flatten_record(df, exclude=(id_col, split_col)))).alias("combined_text"),
    )
    return named.where(F.col("combined_text") != "").withColumn("text_length", F.char_length("combined_text"))


def annotation_corpus(combined: DataFrame, source: str | Column, min_length: int = 50, max_length: int = 5000) -> DataFrame:
    """Texts of admissible length, cleaned; the minimum is checked again after cleaning."""
    return (
        once(combined.where(F.col("text_length").between(min_length, max_length)), "text", tx.clean_corpus_text(F.col("combined_text")))
        .select("id", "split", "text", F.col("text_length").alias("original_length"))
        .withColumn("cleaned_length", F.char_length("text"))
        .where(F.col("cleaned_length") >= min_length)
        .withColumn("source", source if isinstance(source, Column) else F.lit(source))
    )


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """Total, mean, median, minimum and maximum length, one row.

    The admissible lengths bound the number of distinct values the exact median has to hold.
    """
    n = F.col("cleaned_length")
    return corpus.agg(
        F.count(F.lit(1)).alias("total_texts"), F.avg(n).alias("avg_length"), F.median(n).alias("median_length"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
    )


def split_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("split").agg(F.count(F.lit(1)).alias("texts"))


def statistics_object(corpus: DataFrame) -> DataFrame:
    """Statistics plus the counts per split as one row, ready for a single JSON object."""
    splits = split_counts(corpus).agg(F.map_from_entries(F.collect_list(F.struct("split", "texts"))).alias("splits"))
    return corpus_statistics(corpus).withColumn("splits", splits.scalar())


def annotation_statistics(annotated: DataFrame, edges: DataFrame, kb_names: DataFrame) -> DataFrame:
    """Entity totals, annotated knowledge pairs, densities per text and dictionary sizes, one row.

    A pair is an edge ``entity, feature`` whose two names are both annotated in one text.
    """
    texts = annotated.agg(
        F.count(F.lit(1)).alias("annotated_texts"),
        F.coalesce(F.sum(F.size("diseases")), F.lit(0)).alias("diseases"),
        F.coalesce(F.sum(F.size("symptoms")), F.lit(0)).alias("symptoms"),
    )
    d = annotated.select("id", F.explode(F.array_distinct(F.col("diseases.entity"))).alias("entity"))
    s = annotated.select("id", F.explode(F.array_distinct(F.col("symptoms.entity"))).alias("feature"))
    # start from the entities of each text, then keep edges whose feature the same text carries
    pairs = (
        d.join(edges.select("entity", "feature").distinct(), "entity")
        .join(s, ["id", "feature"], "left_semi")
        .agg(F.count(F.lit(1)))
    )
    sizes = kb_names.groupBy("concept_type").agg(F.countDistinct("concept_id").alias("n"))
    kb = sizes.agg(
        F.coalesce(F.sum(F.when(F.col("concept_type") == "DISEASE", F.col("n"))), F.lit(0)).alias("kb_diseases"),
        F.coalesce(F.sum(F.when(F.col("concept_type") == "SYMPTOM", F.col("n"))), F.lit(0)).alias("kb_symptoms"),
    )
    out = texts.withColumn("pairs", pairs.scalar()).withColumn("_kb", kb.select(F.struct("*")).scalar())
    n = F.col("annotated_texts")
    return out.select(
        "annotated_texts", "diseases", "symptoms", "pairs",
        ratio(F.col("diseases"), n).alias("diseases_per_text"),
        ratio(F.col("symptoms"), n).alias("symptoms_per_text"),
        ratio(F.col("pairs"), n).alias("pairs_per_text"),
        F.col("_kb.kb_diseases").alias("kb_diseases"), F.col("_kb.kb_symptoms").alias("kb_symptoms"),
    )


def _annotation(name: str, display: str) -> Column:
    at = (F.instr(F.col("text"), F.col(name)) - 1).cast("int")
    return F.filter(
        F.array(F.struct(F.col(name).alias("entity"), F.col(display).alias("display_name"), at.alias("position"))),
        lambda x: x["position"] >= 0,
    )


# words, runs of white space and single marks: every character is in one
PIECES = r"(?U)\w+|\s+|[^\w\s]"
# what \s is there
_SPACES = np.array([*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_LABELS = ["O", "I-DISEASE", "B-DISEASE", "I-SYMPTOM", "B-SYMPTOM"]


def _covers(own: slice, starts: np.ndarray, ends: np.ndarray, text: str, named: list, placed: list) -> np.ndarray:
    """Twice the number of the last annotation over each piece of a text, one more where it begins there; -1 for none.

    An annotation covers the pieces that its name, sought from its position on (else laid at the position), overlaps.
    """
    cover = np.full(own.stop - own.start, -1)
    known = [(k, n, at) for k, (n, at) in enumerate(zip(named, placed)) if n is not None and at is not None]
    if not known:
        return cover
    found = np.array([max(text.find(n, at), at) for _, n, at in known], dtype=np.int64)
    after = found + np.array([len(n) for _, n, _ in known], dtype=np.int64)
    first = np.searchsorted(ends[own], found, "right").tolist()
    last = np.searchsorted(starts[own], after, "left").tolist()
    for (k, _, _), i, j in zip(known, first, last):
        cover[i:j] = k
    # where an annotation begins decides between the marks of a piece
    begin = np.zeros(known[-1][0] + 1, dtype=np.int64)
    begin[[k for k, _, _ in known]] = found
    return np.where(cover < 0, -1, 2 * cover + (starts[own] <= begin[cover]))


def _token_rows(pieces: pa.Array, texts: pa.Array, names: pa.Array, positions: pa.Array, diseases: pa.Array) -> pa.Array:
    """Token, start, end and label of the words and marks of each text.

    ``pieces`` are all parts of the text in order, so their running lengths are the offsets. The first ``diseases``
    annotations are diseases, the others symptoms.
    """
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    words = pieces.flatten()
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    running = np.concatenate([[0], np.cumsum(lengths)])
    base = np.repeat(running[bounds[:-1]], counts)
    starts, ends = running[:-1] - base, running[1:] - base
    label, token = np.zeros(len(starts), dtype=np.int8), np.zeros(len(starts), dtype=bool)
    for row, (text, named, placed, n) in enumerate(zip(texts, names, positions, diseases.to_pylist())):
        if counts[row] == 0:
            continue
        own, text = slice(bounds[row], bounds[row + 1]), text.as_py()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        token[own] = ~np.isin(points[starts[own]], _SPACES)
        if named.is_valid and placed.is_valid and len(named):
            cover = _covers(own, starts, ends, text, named.as_py(), placed.as_py())
            label[own] = np.where(cover < 0, 0, 1 + (cover & 1) + 2 * ((cover >> 1) >= n))
    kept = np.flatnonzero(token)
    flat = pa.StructArray.from_arrays(
        [words.take(pa.array(kept)), pa.array(starts[kept], pa.int32()), pa.array(ends[kept], pa.int32()),
         pa.array(_LABELS).take(pa.array(label[kept]))],
        names=["token", "start", "end", "label"])
    ahead = np.concatenate([[0], np.cumsum(token)])[bounds]
    missing = pieces.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(ahead, pa.int32(), mask=np.append(missing, False)) if missing.any() else pa.array(ahead, pa.int32()), flat)


_TOKEN = T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()),
                       T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])
_tokens_of = F.arrow_udf(_token_rows, T.ArrayType(_TOKEN)).asNondeterministic()


def _with_tokens(texts: DataFrame, names: Column, positions: Column, diseases: Column) -> DataFrame:
    """``texts`` with ``labelled``: words and marks in order, with places and labels, made in one Arrow pass over the pieces."""
    pieces = once(texts, "_pieces", F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)))
    return pieces.withColumn("labelled", _tokens_of("_pieces", "text", names, positions, diseases)).drop("_pieces")


def tokens_with_offsets(texts: DataFrame) -> DataFrame:
    """Words and punctuation marks of ``id, text`` rows with zero-based start and exclusive end.

    Texts are cut at every token edge and placed inside their own row; tokens are exploded last, not shuffled.
    Null and empty texts have no tokens.
    """
    none = F.array()
    placed = _with_tokens(texts.select("id", "text"), none.cast("array<string>"), none.cast("array<int>"), F.lit(0))
    return placed.select("id", F.posexplode("labelled").alias("token_index", "_t")).select(
        "id", "token_index", "_t.token", "_t.start", "_t.end")


def label_arrays(annotated: DataFrame) -> DataFrame:
    """``id, text, labelled``: the tokens of each text with B-/I-/O labels, in one array per text.

    A later annotation overwrites an earlier one (symptoms come after diseases). Missing annotation arrays
    count as empty.
    """
    diseases = F.coalesce("diseases", F.filter("symptoms", lambda x: F.lit(False)))
    symptoms = F.coalesce("symptoms", F.filter("diseases", lambda x: F.lit(False)))
    both = annotated.select("id", "text", F.coalesce(F.size(diseases), F.lit(0)).alias("_n"), F.concat(diseases, symptoms).alias("_all"))
    return _with_tokens(both, F.col("_all.entity"), F.col("_all.position"), F.col("_n")).select("id", "text", "labelled")


def bio_labels(annotated: DataFrame) -> DataFrame:
    """Token rows with B-/I-/O labels; see :func:`label_arrays`."""
    return label_arrays(annotated).select("id", F.posexplode("labelled").alias("token_index", "_t")).select(
        "id", "token_index", "_t.token", "_t.start", "_t.end", "_t.label")


def _part_extremes(values: pa.Array, order: np.ndarray, cuts: np.ndarray, least: bool) -> pa.Array:
    """Least or greatest value of each part of the places ``order`` that begins at ``cuts``; nulls are passed over."""
    null = values.is_null().to_numpy(zero_copy_only=False)[order]
    whole = pa.types.is_integer(values.type)
    plain = (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False)[order]
    edge = (np.iinfo(plain.dtype).max if least else np.iinfo(plain.dtype).min) if whole else (np.inf if least else -np.inf)
    filled = np.where(null, np.array(edge, dtype=plain.dtype), plain)
    out = (np.minimum if least else np.maximum).reduceat(filled, cuts)
    return pa.array(out, values.type, mask=np.logical_and.reduceat(null, cuts))


def _decoded(texts: pa.Array, labelled: pa.Array) -> pa.Array:
    """Spans of each row: start, end, label, text, confidence."""
    counts = pc.fill_null(pc.list_value_length(labelled), 0).to_numpy(zero_copy_only=False)
    tokens = labelled.flatten()
    coded = tokens.field("label").dictionary_encode()
    words = [w or "" for w in coded.dictionary.to_pylist()]
    code = coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)
    kinds = [w[2:] for w in words]
    numbers = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
    opens = np.array([w.startswith("B-") for w in words] + [False])[code]
    closes = np.array([w == "O" for w in words] + [False])[code]
    kind = np.array([numbers[k] for k in kinds] + [-1])[code]
    row = np.repeat(np.arange(len(counts)), counts)
    openings = np.flatnonzero(opens)
    # the last opening before or at each token, if it is of the same row
    part = np.cumsum(opens) - 1
    inside = part >= 0
    inside[inside] = row[openings[part[inside]]] == row[inside]
    ended = np.concatenate([[0], np.cumsum(closes)])
    at = np.flatnonzero(inside)
    first = openings[part[at]]
    at = at[(ended[at + 1] == ended[first]) & (kind[at] == kind[first])]
    if len(at):
        cuts = np.flatnonzero(np.concatenate([[True], part[at][1:] != part[at][:-1]]))
        start, end, confidence = (_part_extremes(tokens.field(c), at, cuts, c == "start") for c in ("start", "end", "confidence"))
    else:
        start, end, confidence = (tokens.field(c)[:0] for c in ("start", "end", "confidence"))
    ahead = np.concatenate([[0], np.cumsum(np.bincount(row[openings], minlength=len(counts)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ahead), c) for c in (start, end)]
    # a text that is null has spans without text
    cut = zip(tx.cut_parts(texts, *lists).to_pylist(), np.diff(ahead).tolist())
    parts = pa.array([t for own, n in cut for t in ([None] * n if own is None else own)], pa.string())
    flat = pa.StructArray.from_arrays(
        [start, end, pa.array([words[c][2:] for c in code[openings].tolist()], pa.string()), parts, confidence],
        names=["start", "end", "label", "text", "confidence"])
    return pa.ListArray.from_arrays(pa.array(ahead), flat)


def decode_arrays(labelled: DataFrame) -> DataFrame:
    """Spans of ``id, text, labelled`` rows, read off inside the row.

    ``labelled`` holds ``start, end, label, confidence`` in token order. A span opens at B-, goes on over I- of its
    own type, ends at O or the next B-. One Arrow pass reads the tokens and cuts the spans' texts.
    """
    types = {f.name: f.dataType.simpleString() for f in labelled.schema["labelled"].dataType.elementType.fields}
    kind = f"array<struct<start:{types['start']},end:{types['end']},label:string,text:string,confidence:{types['confidence']}>>"
    tokens = F.transform("labelled", lambda t: F.struct(*[t[c].alias(c) for c in ("start", "end", "label", "confidence")]))
    spans = F.arrow_udf(_decoded, kind).asNondeterministic()("text", tokens if set(types) != {
        "start", "end", "label", "confidence"} else F.col("labelled"))
    return labelled.select("id", spans.alias("_spans")).select("id", F.inline("_spans"))


def decode_bio(tokens: DataFrame, text: DataFrame) -> DataFrame:
    """Labelled tokens ``id, token_index, start, end, label, confidence`` to spans.

    The tokens of a text are gathered once (bounded by the text) and decoded there; see :func:`decode_arrays`.
    """
    gathered = tokens.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("token_index", "start", "end", "label", "confidence"))).alias("labelled"))
    return decode_arrays(gathered.join(text.select("id", "text"), "id"))


def ranking_rows(annotated: DataFrame, context_window: int = 50, document_chars: int = 500) -> DataFrame:
    """One positive row per annotation: mention, candidate, contexts and similarity.

    Contexts are cut inside the text's row: what is exploded and goes through the similarity function has no text in it.
    """
    typed = lambda c, kind: F.transform(F.col(c), lambda x: F.struct(
        x["entity"].alias("entity"), x["display_name"].alias("display_name"), F.lit(kind).alias("concept_type"),
        x["position"].alias("start"), (x["position"] + F.char_length(x["entity"])).alias("end")))
    spans = annotated.select(
        "id", "text", F.concat(typed("diseases", "DISEASE"), typed("symptoms", "SYMPTOM")).alias("_all"))
    spans = spans.withColumns({
        "_left": tx.cut(F.col("text"), F.transform("_all", lambda x: x["start"] - context_window), F.col("_all.start")),
        "_right": tx.cut(F.col("text"), F.col("_all.end"), F.transform("_all", lambda x: x["end"] + context_window))})
    rows = spans.select(
        "id", F.substr("text", F.lit(1), F.lit(document_chars)).alias("_document"),
        F.explode(F.zip_with(F.col("_all"), F.arrays_zip("_left", "_right"), lambda x, c: F.struct(
            x["entity"].alias("entity"), x["display_name"].alias("display_name"), x["concept_type"].alias("concept_type"),
            c["_left"].alias("left"), c["_right"].alias("right")))).alias("a"))
    mention = F.col("a.entity")
    return rows.select(
        "id",
        mention.alias("mention_text"), mention.alias("candidate_name"),
        F.col("a.display_name").alias("candidate_display_name"), F.col("a.concept_type").alias("concept_type"),
        F.col("a.left").alias("left_context"), F.col("a.right").alias("right_context"),
        F.col("_document").alias("document_context"),
        similarity.sequence_ratio(F.lower(mention), F.lower(mention)).alias("string_similarity"),
        F.lit(1).alias("label"),
    )


INSTRUCTION = "You answer medical questions with careful, stepwise reasoning."
PROMPT = "### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:\n%s%s"


def instruction_rows(conversations: DataFrame, end_mark: str = "</s>") -> DataFrame:
    """Last user and last assistant message of each conversation in a three-part prompt.

    ``max_by`` aggregates partially, so a conversation of any length is fine.
    """
    role = F.lower("role")
    last = lambda roles: F.coalesce(
        F.max_by("text", F.when(role.isin(*roles), F.col("turn"))), F.lit("")
    )
    # max_by ignores rows whose ordering value is null
    return conversations.groupBy("conv_id").agg(
        last(["user"]).alias("input"), last(["assistant", "chatbot"]).alias("output")
    ).withColumn("instruction", F.lit(INSTRUCTION)).withColumn(
        "text", F.format_string(PROMPT, "instruction", "input", "output", F.lit(end_mark))
    )
