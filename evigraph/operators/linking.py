"""Candidates for mentions and linking of documents.

Candidate stages per concept type: exact 1.0, alias 0.9, fuzzy (sequence ratio in [0.7, 1)) and,
where fewer than five were found so far, partial containment at 0.8 of the length ratio.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import similarity
from evigraph.functions.ordered import top_per_group
from evigraph.operators import dictionary as dc
from evigraph.session import cut_lineage, spread

STAGES = ("exact", "alias", "fuzzy", "partial")
FUZZY_MIN = 0.7
PARTIAL_GATE = 5


def _rows(df: DataFrame, score: Column, stage: int) -> DataFrame:
    return df.select(
        "mention", "concept_type", "concept_id", "name", "display_name", "load_seq",
        score.cast("double").alias("score"), F.lit(stage).alias("stage"),
    )


def exact_candidates(mentions: DataFrame, names: DataFrame) -> DataFrame:
    hit = mentions.join(names, F.col("mention") == F.col("name"))
    return _rows(hit, F.lit(1.0), 0)


def alias_candidates(mentions: DataFrame, names: DataFrame, all_names: DataFrame) -> DataFrame:
    """Alias hits of mentions that are not a name of the same type."""
    concepts = all_names.groupBy("concept_type", "concept_id").agg(
        F.min_by(F.struct("name", "display_name", "load_seq"), "load_seq").alias("_c")
    ).select("concept_type", "concept_id", "_c.*")
    hits = (
        mentions.join(dc.alias_table(all_names).select("concept_type", "alias", "concept_id"), F.col("mention") == F.col("alias"))
        .join(names.select("concept_type", F.col("name").alias("mention")), ["concept_type", "mention"], "left_anti")
        .join(concepts, ["concept_type", "concept_id"])
    )
    return _rows(hits, F.lit(0.9), 1)


def _triples(texts: DataFrame, col: str, rarity: DataFrame, minimum: float, first: bool) -> DataFrame:
    """Keys of each text per partner length: three of its rarest character tokens and both lengths.

    Texts of la and lb characters with a ratio of at least r have t = ceil(r/2 * (la + lb)) characters in
    common, so at least three of them (t, if that is less) are among the la - t + 3 rarest tokens of one
    and the lb - t + 3 rarest of the other: they share a triple. Where t is below three, filler tokens
    that every text has take the missing places.
    """
    length = F.char_length(col)
    ordered = similarity.char_tokens(texts, col).join(rarity, "token", "left").groupBy(col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("_o")
    )
    shortest = F.ceil(F.lit(minimum / (2 - minimum)) * length - 1e-9)
    longest = F.floor(F.lit((2 - minimum) / minimum) * length + 1e-9)
    partner = ordered.withColumn("_l", F.explode(F.sequence(F.greatest(shortest, F.lit(1)), longest)))
    common = F.ceil(F.lit(minimum / 2) * (length + F.col("_l")) - 1e-9)
    filler = F.slice(F.array(F.lit("\x01"), F.lit("\x02")), F.lit(1), F.greatest(3 - common, F.lit(0)).cast("int"))
    prefix = F.concat(filler, F.slice("_o", F.lit(1), (length - common + F.least(common, F.lit(3))).cast("int")))
    rest = lambda at: F.slice("_p", at + 2, F.greatest(F.size("_p") - at - 1, F.lit(0)))
    one = partner.select(col, "_l", prefix.alias("_p")).select("*", F.posexplode("_p").alias("_i", "_a"))
    two = one.select("*", F.posexplode(rest(F.col("_i"))).alias("_j", "_b"))
    three = two.select("*", F.explode(rest(F.col("_i") + F.col("_j") + 1)).alias("_c"))
    pair = (length, F.col("_l")) if first else (F.col("_l"), length)
    return three.select(col, F.xxhash64(*[x.cast("int") for x in pair], "_a", "_b", "_c").alias("key"))


def fuzzy_pairs(mentions: DataFrame, names: DataFrame, minimum: float = FUZZY_MIN) -> DataFrame:
    """Distinct (mention, name) texts with a sequence ratio in [minimum, 1).

    Exact filters before any Python, none of which a qualifying pair can fail: a shared triple of rare
    character tokens for the very pair of lengths (an equi-join), then the edit distance.
    """
    words = names.select("name").where(F.char_length("name") > 0).distinct()
    asked = mentions.select("mention").where(F.char_length("mention") > 0).distinct()
    rarity = (
        similarity.char_tokens(words, "name")
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    )
    left = _triples(asked, "mention", rarity, minimum, True)
    right = _triples(words, "name", rarity, minimum, False)
    met = left.join(right, "key").where(F.col("mention") != F.col("name")).select("mention", "name").distinct()
    total = F.char_length("mention") + F.char_length("name")
    limit = F.floor(F.lit(1 - minimum) * total + 1e-9).cast("int")
    # unmatched characters bound the edit distance from above; native, and it stops at the limit
    near = spread(met.where(F.levenshtein("mention", "name") <= limit))
    return (
        near.select("mention", "name", similarity.sequence_ratio("mention", "name").alias("ratio"))
        .where((F.col("ratio") >= minimum) & (F.col("ratio") < 1.0))
    )


def fuzzy_candidates(mentions: DataFrame, names: DataFrame) -> DataFrame:
    return _rows(fuzzy_pairs(mentions, names).join(names, "name"), F.col("ratio"), 2)


def containment_pairs(mentions: DataFrame, names: DataFrame, minimum: float = 0.5) -> DataFrame:
    """(mention, name) texts, three characters or more, one inside the other, length ratio >= minimum.

    The shorter text's rarest gram occurs in the longer one: two equi-joins, one per direction.
    """
    words = names.select("name").distinct().where(F.char_length("name") >= 3)
    asked = mentions.select("mention").distinct().where(F.char_length("mention") >= 3)
    by_name = dc.with_anchor(words, "name", ("name",)).join(
        spread(asked).withColumn("anchor", F.explode(dc.anchor_grams(F.col("mention")))), "anchor"
    ).where(F.contains("mention", "name"))
    by_mention = dc.with_anchor(asked, "mention", ("mention",)).join(
        spread(words).withColumn("anchor", F.explode(dc.anchor_grams(F.col("name")))), "anchor"
    ).where(F.contains("name", "mention") & (F.col("name") != F.col("mention")))
    both = by_name.select("mention", "name").unionByName(by_mention.select("mention", "name"))
    return both.withColumn("ratio", similarity.length_ratio(F.col("mention"), F.col("name"))).where(
        F.col("ratio") >= minimum
    )


def partial_candidates(mentions: DataFrame, names: DataFrame) -> DataFrame:
    return _rows(containment_pairs(mentions, names).join(names, "name"), F.col("ratio") * 0.8, 3)


def generate_candidates(
    mentions: DataFrame, kb_names: DataFrame, max_candidates: int | None = 10, stages: Sequence[str] = STAGES
) -> DataFrame:
    """Ranked candidates per mention. Result: mention, rank, candidate columns, score, stage.

    The gate on partial matches counts earlier candidates before duplicates go; a concept keeps its
    first stage, not its best score.
    """
    # mentions and names feed every stage: written once rather than derived again per stage
    asked = cut_lineage(mentions.select(F.lower(F.trim("mention")).alias("mention")).distinct())
    names = cut_lineage(dc.last_loaded(kb_names))
    parts = []
    if "exact" in stages:
        parts.append(exact_candidates(asked, names))
    if "alias" in stages:
        parts.append(alias_candidates(asked, names, kb_names))
    if "fuzzy" in stages:
        parts.append(fuzzy_candidates(asked, names))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if "partial" in stages:
        found = cut_lineage(found)
        crowded = found.groupBy("mention", "concept_type").agg(F.count(F.lit(1)).alias("_n")).where(
            F.col("_n") >= PARTIAL_GATE
        )
        found = found.unionByName(
            partial_candidates(asked, names).join(crowded, ["mention", "concept_type"], "left_anti")
        )
    unique = found.groupBy("mention", "concept_type", "concept_id").agg(
        F.min(F.struct("stage", "load_seq", "name", "display_name", "score")).alias("_f")
    ).select("mention", "concept_type", "concept_id", "_f.*")
    order = [F.desc("score"), F.asc("concept_type"), F.asc("stage"), F.asc("concept_id")]
    counted = unique.groupBy("mention").agg(F.count(F.lit(1)).alias("_all"))
    limit = max_candidates if max_candidates is not None else (1 << 31) - 1
    ranked = top_per_group(unique, ["mention"], order, limit)
    stage_name = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("stage") + 1)
    return ranked.join(counted, "mention").select(
        "mention", "rank", "concept_type", "concept_id", "name", "display_name", "score",
        stage_name.alias("stage"), F.least("_all", F.lit(limit)).cast("int").alias("candidates_considered"),
    )


def pick_best(candidates: DataFrame) -> DataFrame:
    """The first candidate of each mention."""
    return candidates.where(F.col("rank") == 1).drop("rank")


def link_mentions(spans: DataFrame, kb_names: DataFrame, threshold: float = 0.6, max_candidates: int = 10,
                  keep_unknown: bool = False, stages: Sequence[str] = STAGES) -> DataFrame:
    """Spans ``doc_id, start, end, mention`` with the concept picked for each.

    Candidates are generated once per distinct mention, however often it occurs.
    """
    best = pick_best(generate_candidates(spans.select("mention"), kb_names, max_candidates, stages))
    keyed = spans.withColumn("_m", F.lower(F.trim("mention")))
    joined = keyed.join(best.withColumnRenamed("mention", "_m"), "_m", "left" if keep_unknown else "inner")
    return joined.select(
        "doc_id", "mention", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"),
        F.coalesce("concept_id", F.lit("UNKNOWN")).alias("concept_id"),
        F.col("name").alias("concept_name"),
        "display_name", F.coalesce("concept_type", F.lit("UNKNOWN")).alias("concept_type"),
        F.coalesce("score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("candidates_considered", F.lit(0)).alias("candidates_considered"),
        F.coalesce("stage", F.lit("none")).alias("disambiguation_method"),
    ).where(F.lit(keep_unknown) | (F.col("confidence_score") >= threshold))


def link_documents(docs: DataFrame, kb_names: DataFrame, threshold: float = 0.6, max_candidates: int = 10, **options) -> DataFrame:
    """Dictionary extraction, candidates, pick and threshold for a document table, as flat rows."""
    spans = dc.extract_entities(docs, kb_names, **options).select("doc_id", "start", "end", "mention")
    return link_mentions(spans, kb_names, threshold, max_candidates)


def predictions(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Documents with their linked entities as an array (empty when there are none)."""
    cols = ["mention", "start_pos", "end_pos", "concept_id", "concept_name", "display_name", "concept_type",
            "confidence_score", "candidates_considered", "disambiguation_method"]
    nested = linked.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*cols)), lambda a, b: a["start_pos"] - b["start_pos"]).alias("entities")
    )
    kind = nested.schema["entities"].dataType
    return docs.select("doc_id", "text").join(nested, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("entities", F.array().cast(kind)).alias("entities")
    )
