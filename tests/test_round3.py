"""Extraction inside the row, contexts, and questions answered once per set of features."""

import random

from pyspark.sql import functions as F

from evigraph.functions import ordered, text as tx
from evigraph.operators import corpus as cp
from evigraph.operators import dictionary as dc
from evigraph.operators import graph as gr
from evigraph.operators import predict as pd_

KB = "concept_id STRING, name STRING, display_name STRING, concept_type STRING, load_seq LONG"


def _kb(spark, names):
    return spark.createDataFrame([(f"{t}:{n}", n, n.title(), t, 0) for t, n in names], KB)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_takes_no_shuffle_of_hits(spark):
    kb = _kb(spark, [("SYMPTOM", "abc"), ("DISEASE", "abc def"), ("SYMPTOM", "def")])
    docs = spark.createDataFrame([(1, "abc def abc"), (2, "xdefx"), (3, None)], "doc_id LONG, text STRING")
    found = dc.extract_entities(docs, kb)
    assert "hashpartitioning" not in _plan(found)
    assert {(r.doc_id, r.start, r.end, r.label, r.mention) for r in found.collect()} == {(1, 0, 7, "DISEASE", "abc def"), (2, 1, 4, "SYMPTOM", "def")}
    annotated = dc.annotate(docs, kb)
    assert "hashpartitioning" not in _plan(annotated)
    assert {(r.id, len(r.diseases), len(r.symptoms)) for r in annotated.collect()} == {("1", 1, 0), ("2", 0, 1), ("3", 0, 0)}


def test_extraction_equals_a_plain_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé\U0001F600 ") for _ in range(rng.randint(3, 9)))
    names = sorted({word() for _ in range(200)})
    texts = ["".join(rng.choice("abé\U0001F600 .") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts += ["b" * 300_000 + names[0] + "b" * 300_000 + " " + names[0] + "."]  # longer than a stretch
    kb = _kb(spark, [("T", n) for n in names])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    part = lambda c: c.isalnum()

    def first(text, name, bounded):
        at = text.find(name)
        while bounded and at >= 0 and ((at and part(text[at - 1])) or (at + len(name) < len(text) and part(text[at + len(name)]))):
            at = text.find(name, at + 1)
        return at

    for bounded in (False, True):
        want = {(i, n, first(t, n, bounded)) for i, t in enumerate(texts) for n in names if first(t, n, bounded) >= 0}
        got = [(r.doc_id, r.name, r.start) for r in dc.find_names(docs, kb, word_bounded=bounded).collect()]
        assert set(got) == want and len(got) == len(want)
        kept = set()
        for i in range(len(texts)):
            until = 0
            for s, e in sorted(((s, s + len(n)) for d, n, s in want if d == i), key=lambda x: (x[0], -x[1])):
                if s >= until:
                    kept.add((i, s, texts[i][s:e]))
                    until = e
        assert {(r.doc_id, r.start, r.mention) for r in dc.extract_entities(docs, kb, word_bounded=bounded).collect()} == kept


def test_texts_that_share_an_id_are_judged_together(spark):
    kb = _kb(spark, [("SYMPTOM", "abc"), ("DISEASE", "abc def"), ("SYMPTOM", "def")])
    docs = spark.createDataFrame([(1, "abc def"), (1, "..abc"), (None, "def"), (None, "abc def"), (2, "def")], "doc_id LONG, text STRING")
    got = sorted(((r.doc_id or 0, r.start, r.mention) for r in dc.extract_entities(docs, kb).collect()))
    assert got == [(0, 0, "abc def"), (1, 0, "abc def"), (2, 0, "def")]
    annotated = {(r.id, r.text, len(r.diseases) + len(r.symptoms)) for r in dc.annotate(docs, kb).collect()}
    assert annotated == {("1", "abc def", 1), ("1", "..abc", 1), (None, "def", 0), (None, "abc def", 0), ("2", "def", 1)}


def test_parts_of_a_text_are_cut_in_one_pass(spark):
    df = spark.createDataFrame([("ab\U0001F600cd", [0, 2, -3, None], [2, 9, 1, 3]), (None, [1], [2])], "t STRING, s ARRAY<INT>, e ARRAY<INT>")
    assert [r[0] for r in df.select(tx.cut(F.col("t"), F.col("s"), F.col("e"))).collect()] == [["ab", "\U0001F600cd", "a", None], None]
    kind = "array<struct<entity:string,display_name:string,position:int>>"
    annotated = spark.createDataFrame([("1", "one two three", [("two", "Two", 4)], [])], f"id string, text string, diseases {kind}, symptoms {kind}")
    rows = cp.ranking_rows(annotated, context_window=2)
    (r,) = rows.collect()
    assert (r.left_context, r.right_context, r.document_context, r.string_similarity) == ("e ", " t", "one two three", 1.0)
    # no text goes into the similarity function
    narrow = rows.select("id", "string_similarity")
    after = _plan(narrow).split("Generate")[0]
    assert "text#" not in after


def test_equal_questions_are_answered_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (None, "c"), (3, None)], "k LONG, f STRING")
    members, items = ordered.bags(rows, "k", "f")
    assert items.count() == 3 and members.select("bag_id").distinct().count() == 2
    assert {r.k for r in members.collect()} == {1, 2, None}
    edges = spark.createDataFrame([(10, "symptom::a", 0.5), (10, "symptom::b", 0.4), (11, "symptom::a", 0.8)], "entity_id LONG, feature_id STRING, weight DOUBLE")
    features = spark.createDataFrame([("symptom::a", "a", "A"), ("symptom::b", "b", "B")], "id STRING, name STRING, display_name STRING")
    entities = spark.createDataFrame([(10, "x", "X"), (11, "y", "Y")], "id LONG, name STRING, display_name STRING")
    asked = spark.createDataFrame([(q, f) for q in range(50) for f in "ab"] + [(None, "a")], "query_id LONG, feature STRING")
    got = {(r.query_id, r.rank, r.entity_id, r.matched_count) for r in gr.rank_entities(asked, entities, features, edges).collect()}
    assert got == {(q, r, e, n) for q in range(50) for r, e, n in ((1, 10, 2), (2, 11, 1))} | {(None, 1, 11, 1), (None, 2, 10, 1)}
    cases = asked.select(F.col("query_id").alias("case_id"), F.concat(F.lit("symptom::"), "feature").alias("feature_id"))
    scores = pd_.prior_scores(cases, edges)
    assert scores.count() == 102
    best = pd_.predict_top_k(cases.where("case_id is not null"), edges, pd_.label_vocabulary(edges), 1).collect()
    assert {(r.case_id, r.entity_id, r.matched_symptoms) for r in best} == {(q, 10, 2) for q in range(50)}
