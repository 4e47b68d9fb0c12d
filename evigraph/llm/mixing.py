"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.ordered import dense_index
from evigraph.llm.common import scalars, written

# A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
# Hexadecimal digits of the draw that make a hash range: 4,096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sources: DataFrame, weights: list[int], max_epochs: int, share: float = 1.0) -> DataFrame:
    """Words each source gives: columns ``source_no``, ``source``, ``source_size``, ``weight``, ``target``.

    ``sources``: one row per source with ``source`` and ``source_size``. Sources in code point order
    (null last) weigh ``weights`` in turn. The common level starts at total / weights; sources whose
    weighted level exceeds ``max_epochs`` times their size are clamped there, and the level is raised
    over the others until nobody exceeds the cap. Only the level travels to the driver, so the number
    of sources is free. Empty sources get target 0; an empty table gives no rows.
    """
    numbered = written(dense_index(sources, [F.col("source").asc_nulls_last()], "source_no")).withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).cast("bigint"),
            "cap": F.col("source_size") * max_epochs,
        }
    )
    total, weight = scalars(numbered, F.sum("source_size"), F.sum("weight"))
    total = (total or 0) * share
    level, clamped = (total / weight if weight else 0.0), -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        n, capped, free = scalars(
            numbered,
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)),
            F.sum(F.when(~above, F.col("weight"))),
        )
        if n == clamped or not free:
            break
        level, clamped = (total - capped) / free, n
    filled = F.col("weight") * F.lit(level)
    return numbered.withColumn("target", F.when(F.col("cap") < filled, F.col("cap").cast("double")).otherwise(filled)).drop("cap")


def draw_key(doc_id: Column, seed: int) -> Column:
    """The seeded draw of a document as hexadecimal digits; the same on every engine and rerun."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string")))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns(
        {
            "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"),
            "_draw": draw_key(F.col("doc_id"), seed),
        }
    )


def _crossing(sums: DataFrame, order: str) -> DataFrame:
    """The row of each source in which the running sum of ``part`` reaches the quota."""
    upto = F.sum("part").over(Window.partitionBy("source_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("rest", F.col("quota") - (upto - F.col("part"))).where((F.col("rest") > 0) & (F.col("rest") <= F.col("part")))


def plan_mix(sized: DataFrame, weights: list[int], max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """The mix as one row per source: target, whole repetitions and where the fraction ends.

    ``sized``: ``source, _size, _draw``. Result: ``source, source_size, target, whole, cut, rest, ties``.
    The fraction of a source is filled in the order of the draws up to ``cut``; the ``ties`` documents
    with that very draw share the remaining ``rest`` words evenly (and lose the remainder of that
    division). The cut is found in two levels: sums of hash ranges, then the one range that holds it.
    """
    sources = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = written(
        source_targets(sources, weights, max_epochs, share)
        .withColumn("whole", whole.cast("bigint"))
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint") - F.col("whole") * F.col("source_size"))
    )
    ranged = (
        sized.alias("d")
        .join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("s.source_no", "s.quota", "d._size", "d._draw", F.substring("d._draw", 1, RANGE_DIGITS).alias("range"))
    )
    ranges = ranged.groupBy("source_no", "quota", "range").agg(F.sum("_size").alias("part"))
    last = _crossing(ranges, "range").select("source_no", "range", F.col("rest").alias("left"))
    inside = ranged.join(last, ["source_no", "range"]).groupBy("source_no", "_draw").agg(
        F.sum("_size").alias("part"), F.count(F.lit(1)).alias("ties"), F.first("left").alias("quota")
    )
    cuts = _crossing(inside, "_draw").select("source_no", F.col("_draw").alias("cut"), "rest", "ties")
    return written(
        targets.join(cuts, "source_no", "left").select("source", "source_size", "target", "whole", "cut", "rest", "ties")
    )


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    part = (
        F.when(F.col("_draw") < F.col("cut"), F.col("_size"))
        .when(F.col("_draw") == F.col("cut"), F.least(F.col("_size"), F.floor(F.col("rest") / F.col("ties"))))
        .otherwise(F.lit(0))
    )
    return (
        sized.alias("d")
        .join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .withColumn("_taken", (F.col("whole") * F.col("_size") + part).cast("bigint"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """Words of every document that the mix takes, whole repetitions and a seeded fraction.

    Every document of a source is repeated floor(target / source size) times. The rest of the target
    is filled in the order of a seeded hash of ``doc_id``; the document on the boundary gives its
    leading words only, so a source misses its target by less than one word.

    Result: ``doc_id, size, source, source_size, target, taken``. A null text has size 0, as has an
    empty one; both take 0. Null sources form one source. Rows with equal ``doc_id`` share a draw and
    are taken alike. Other columns of ``docs`` are ignored; an empty table gives no rows.

    Native functions only. Documents meet a table with one row per source, so a source with any part
    of all rows is never gathered; only sums of (source, hash range) and one range's draws are shuffled.
    """
    sized = written(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return _taken(sized, plan_mix(sized, list(weights), max_epochs, share)).select(
        "doc_id", F.col("_size").alias("size"), "d.source", "source_size", "target", F.col("_taken").alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: every document as often as the mix takes it.

    A document is repeated ``taken / size`` times; a last, partial repetition holds its leading words.
    Documents without words carry nothing to weigh: they stay once. ``n_chars`` follows the text.
    Texts are not shuffled.
    """
    names = docs.columns
    row = docs.select("doc_id", "source", "text", F.struct(*names).alias("_row"))
    sized = _sized(row, seed)
    plan = plan_mix(written(sized.select("source", "_size", "_draw")), list(weights), max_epochs, share)
    size, taken = F.col("_size"), F.col("_taken")
    times = F.when(size == 0, F.lit(1)).otherwise(F.ceil(taken / size)).cast("int")
    turns = F.explode(F.when(times > 0, F.sequence(F.lit(1), times))).alias("_turn")
    words = F.least(taken - (F.col("_turn") - 1) * size, size).cast("int")
    pieces = F.regexp_extract_all(F.col("d.text"), F.lit(SPACED_WORD), F.lit(0))
    text = F.when(words < size, F.array_join(F.slice(pieces, F.lit(1), words), "")).otherwise(F.col("d.text"))
    cut = _taken(sized, plan).select("*", turns).withColumn("_text", text)
    return cut.select(*[
        F.col("_text").alias(c) if c == "text" else F.length("_text").cast("bigint").alias(c) if c == "n_chars" else F.col("d._row")[c].alias(c)
        for c in names
    ])
