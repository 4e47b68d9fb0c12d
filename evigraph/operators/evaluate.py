"""Evaluation of linked spans and of class predictions.

Span rows: ``id, seq, text, type, start, end``. A document's spans are matched inside one row; all
totals are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.numeric import harmonic, ratio
from evigraph.functions.ordered import top_per_group

_SPAN = "array<struct<seq:int,text:string,type:string,start:int,end:int>>"


def predicted_spans(predictions: DataFrame) -> DataFrame:
    """Predicted entities in the common span shape."""
    return predictions.select("id", F.posexplode("entities").alias("seq", "e")).select(
        "id", "seq", F.col("e.mention").alias("text"), F.col("e.concept_type").alias("type"),
        F.col("e.start_pos").alias("start"), F.col("e.end_pos").alias("end"),
    )


def true_spans(annotated: DataFrame) -> DataFrame:
    """Annotations in the common span shape: diseases first, then symptoms."""
    typed = lambda c, kind: F.transform(
        F.col(c), lambda x: F.struct(x["entity"].alias("text"), F.lit(kind).alias("type"), x["position"].alias("start")))
    rows = annotated.select("id", F.posexplode(F.concat(typed("diseases", "DISEASE"), typed("symptoms", "SYMPTOM"))).alias("seq", "e"))
    return rows.select("id", "seq", "e.text", "e.type", "e.start",
                       (F.col("e.start") + F.char_length("e.text")).cast("int").alias("end"))


def _clusters(spans: DataFrame) -> DataFrame:
    """A number per run of spans of a document that overlap each other in a chain, predictions or truths.

    One sweep over the starts: a span opens a new run where every earlier one has ended. Spans of
    different runs can't overlap, so a run is matched on its own.
    """
    sweep = Window.partitionBy("id").orderBy("start", "end", "side", "seq")
    before = sweep.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(False))
    flagged = spans.withColumn("_opens", opens.cast("int"))
    return flagged.withColumn("run", F.sum("_opens").over(sweep.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def match_spans(pred: DataFrame, truth: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per match: ``id, kind, overlap, pred, truth``.

    Predictions are taken in order; each takes the free truth with the largest overlap (the first on
    ties). Kinds: exact, type_mismatch (overlap >= 0.8), partial, no_match, missing. With ``ids`` only
    their spans count. A null id is a document like any other.

    Spans are cut into runs that overlap (see :func:`_clusters`) and folded run by run, so the work grows
    with the number of spans unless a great many of them overlap at one place.
    """
    item = F.struct(F.col("seq").cast("int").alias("seq"), "text", "type", F.col("start").cast("int").alias("start"),
                    F.col("end").cast("int").alias("end"))
    cols = ["id", "seq", "text", "type", "start", "end"]
    spans = pred.select(*cols, F.lit(0).alias("side")).unionByName(truth.select(*cols, F.lit(1).alias("side")))
    if ids is not None:
        spans = spans.join(ids.select("id").distinct(), "id", "left_semi")
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, item)))
    empty = F.array().cast(_SPAN)
    both = _clusters(spans).groupBy("id", "run").agg(F.coalesce(side(0), empty).alias("p"), F.coalesce(side(1), empty).alias("t"))
    match_type = "struct<p:int,t:int,overlap:double>"

    def overlap(a: Column, b: Column) -> Column:
        common = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        longest = F.greatest(a["end"] - a["start"], b["end"] - b["start"])
        return F.when(common > 0, common / longest)

    def step(s: Column, i: Column) -> Column:
        a = F.get(F.col("p"), i)
        options = F.transform(
            F.col("t"),
            lambda b, j: F.when(
                overlap(a, b).isNotNull() & ~F.array_contains(s["used"], j),
                F.struct(overlap(a, b).alias("overlap"), (-j).alias("neg"), j.alias("t")),
            ),
        )
        best = F.array_max(options)
        return F.struct(
            F.when(best.isNotNull(), F.array_append(s["used"], best["t"])).otherwise(s["used"]).alias("used"),
            F.array_append(
                s["out"],
                F.struct(i.cast("int").alias("p"), best["t"].alias("t"), F.coalesce(best["overlap"], F.lit(0.0)).alias("overlap")),
            ).alias("out"),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{match_type}>").alias("out"))
    index = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    folded = both.withColumn("_s", F.aggregate(index, start, step))
    missing = F.transform(
        F.filter(F.transform("t", lambda b, j: j), lambda j: ~F.array_contains(F.col("_s.used"), j)),
        lambda j: F.struct(F.lit(None).cast("int").alias("p"), j.cast("int").alias("t"), F.lit(0.0).alias("overlap")),
    )
    rows = folded.select("id", "p", "t", F.explode(F.concat("_s.out", missing)).alias("m"))
    rows = rows.select("id", F.get("p", F.col("m.p")).alias("pred"), F.get("t", F.col("m.t")).alias("truth"),
                       F.col("m.overlap").alias("overlap"))
    kind = (
        F.when(F.col("truth").isNull(), "no_match").when(F.col("pred").isNull(), "missing")
        .when(F.col("overlap") < 0.8, "partial")
        .when(F.col("pred.type") == F.col("truth.type"), "exact").otherwise("type_mismatch")
    )
    return rows.withColumn("kind", kind)


_KINDS = {"exact_matches": "exact", "partial_matches": "partial", "type_mismatches": "type_mismatch",
          "false_positives": "no_match", "false_negatives": "missing"}


def document_metrics(matches: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Match counts and precision, recall, F1, accuracy per document (or over all with ``by=()``)."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counts = matches.groupBy(*by).agg(
        *[count(F.col("kind") == k).alias(n) for n, k in _KINDS.items()],
        count(F.col("pred").isNotNull()).alias("total_predictions"),
        count(F.col("truth").isNotNull()).alias("total_ground_truth"),
    )
    good = F.col("exact_matches")
    return (
        counts.withColumn("precision", ratio(good, F.col("total_predictions")))
        .withColumn("recall", ratio(good, F.col("total_ground_truth")))
        .withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
        .withColumn("accuracy", ratio(good, F.greatest("total_predictions", "total_ground_truth")))
    )


def type_metrics(matches: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Precision, recall, F1 and support per entity type."""
    p, t = F.col("pred.type"), F.col("truth.type")
    mark = lambda kind, what: F.struct(kind.alias("type"), F.lit(what).alias("what"))
    marks = (
        F.when(F.col("kind") == "exact", F.array(mark(p, "tp")))
        .when(F.col("kind") == "no_match", F.array(mark(p, "fp")))
        .when(F.col("kind") == "missing", F.array(mark(t, "fn")))
        .when(F.col("kind") == "type_mismatch", F.array(mark(p, "fp"), mark(t, "fn")))
    )
    counts = (
        matches.select(*by, F.explode(marks).alias("m")).groupBy(*by, F.col("m.type").alias("type"))
        .agg(*[F.sum((F.col("m.what") == w).cast("bigint")).alias(w) for w in ("tp", "fp", "fn")])
    )
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
        .withColumn("support", F.col("tp") + F.col("fn"))
    )


def corpus_type_metrics(per_document: DataFrame) -> DataFrame:
    """Support-weighted means of per-document type metrics."""
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    return per_document.groupBy("type").agg(
        weighted("precision"), weighted("recall"), weighted("f1_score"), F.sum("support").alias("support")
    )


def common_errors(matches: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent false-positive and false-negative texts."""
    rows = matches.where(F.col("kind").isin("no_match", "missing")).select(
        F.when(F.col("kind") == "no_match", "false_positive").otherwise("false_negative").alias("error"),
        F.coalesce("pred.text", "truth.text").alias("text"),
    )
    counted = rows.groupBy("error", "text").agg(F.count(F.lit(1)).alias("times"))
    return top_per_group(counted, ["error"], [F.desc("times"), F.asc("text")], n)


def evaluation_report(matches: DataFrame) -> DataFrame:
    """All corpus metrics as ``section, metric, value`` rows."""
    overall = document_metrics(matches, by=())
    names = ["precision", "recall", "f1_score", "accuracy", "total_predictions", "total_ground_truth", *_KINDS]
    section = lambda n: "entity" if n in _KINDS else "overall"

    def long(df: DataFrame, label: Column, cols: list[str], sections) -> DataFrame:
        items = F.array(*[F.struct(sections(c), F.concat(label, F.lit(c)).alias("metric"),
                                   F.col(c).cast("double").alias("value")) for c in cols])
        return df.select(F.explode(items).alias("x")).select("x.*")

    first = long(overall, F.lit(""), names, lambda c: F.lit(section(c)).alias("section"))
    types = corpus_type_metrics(type_metrics(matches))
    second = long(types, F.concat(F.col("type"), F.lit(".")), ["precision", "recall", "f1_score", "support"],
                  lambda c: F.lit("type").alias("section"))
    errors = common_errors(matches).select(
        F.concat(F.lit("common_"), F.col("error")).alias("section"), F.col("text").alias("metric"),
        F.col("times").cast("double").alias("value"),
    )
    return first.unionByName(second).unionByName(errors)


def entity_totals(predictions: DataFrame, annotated: DataFrame) -> DataFrame:
    """Numbers of predicted and of true entities."""
    true_n = annotated.agg(F.sum(F.size("diseases") + F.size("symptoms"))).scalar()
    return predictions.agg(F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("predicted")).withColumn(
        "true", F.coalesce(true_n, F.lit(0))
    )


def simple_hits(predictions: DataFrame, annotated: DataFrame) -> DataFrame:
    """Simple evaluation: a true entity counts when its text lies inside some predicted mention."""
    truth = annotated.select("id", F.concat("diseases.entity", "symptoms.entity").alias("_t"))
    pred = predictions.select("id", F.transform("entities", lambda e: F.lower(e["mention"])).alias("_p"))
    hits = F.filter("_t", lambda t: F.exists("_p", lambda p: F.contains(p, F.lower(t))))
    sums = truth.join(pred, "id").agg(
        F.coalesce(F.sum(F.size("_t")), F.lit(0)).alias("total_true"),
        F.coalesce(F.sum(F.size("_p")), F.lit(0)).alias("total_predicted"),
        F.coalesce(F.sum(F.size(hits)), F.lit(0)).alias("correct"),
    )
    return (
        sums.withColumn("precision", ratio(F.col("correct"), F.col("total_predicted")))
        .withColumn("recall", ratio(F.col("correct"), F.col("total_true")))
        .withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
    )


def classification_metrics(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1 from one confusion count."""
    confusion = df.groupBy(F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    parts = confusion.select(
        F.explode(F.array(
            F.struct(F.col("_t").alias("c"), F.when(F.col("_t") == F.col("_p"), F.col("n")).otherwise(0).alias("tp"),
                     F.col("n").alias("true"), F.lit(0).cast("bigint").alias("pred")),
            F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("true"),
                     F.col("n").alias("pred")),
        )).alias("x")
    )
    per = parts.groupBy("x.c").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "true", "pred")])
    per = per.withColumn("f1", ratio(2 * F.col("tp"), F.col("true") + F.col("pred")))
    return per.agg(
        F.sum("true").alias("n"),
        ratio(F.sum("tp"), F.sum("true")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        ratio(F.sum(F.col("f1") * F.col("true")), F.sum("true")).alias("f1_weighted"),
    )


def top_k_accuracy(ranked: DataFrame, truth: str = "label", pred: str = "entity_id", ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of cases ``case_id`` whose true label is among the first k ranked predictions."""
    best = ranked.groupBy("case_id").agg(
        F.min(F.when(F.col(truth) == F.col(pred), F.col("rank"))).alias("_r")
    )
    return best.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(F.col("_r") <= k, 1.0).otherwise(0.0)).alias(f"top{k}_accuracy") for k in ks],
    )
