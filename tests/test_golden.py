"""Hand-computed cases per operator."""

import math
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evigraph.functions import ordered as od
from evigraph.functions import text as tx
from evigraph.operators import chunking as ck
from evigraph.operators import conversation as cv
from evigraph.operators import corpus as cp
from evigraph.operators import dictionary as dc
from evigraph.operators import documents as dm
from evigraph.operators import evaluate as ev
from evigraph.operators import fusion as fu
from evigraph.operators import graph as gr
from evigraph.operators import linking as ln
from evigraph.operators import memo as mm
from evigraph.operators import monitoring as mo
from evigraph.operators import pairs as pr
from evigraph.operators import predict as pd_
from evigraph.operators import retrieval as rt
from evigraph.operators import safety as sf
from evigraph.operators import sampling as sp
from evigraph.operators import walks as wk
from evigraph.operators import weights as wt

DISEASES = [("d1", "Flu", "fever, cough, headache"), ("d2", "Cold", "cough, sneezing"), ("d3", "Migraine", "severe headache, nausea,, "), ("d4", "None", None)]


@pytest.fixture(scope="module")
def pairs(spark):
    df = spark.createDataFrame(DISEASES, "disease_id STRING, disease STRING, common_symptom STRING")
    return pr.explode_pairs(df).cache()


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x STRING").select(expr(F.col("x")).alias("y")).first()["y"]


def test_weights(pairs):
    got = {(r.entity_id, r.feature): r for r in wt.combined_weights(pairs).collect()}
    assert len(got) == 7
    r = got["d1", "fever"]
    assert r.tfidf_weight == pytest.approx(0.366204, abs=1e-6) and r.pmi_weight == pytest.approx(0.847298, abs=1e-6)
    assert r.final_weight == pytest.approx(0.638095, abs=1e-6) and r.weight_category == "Strong"
    assert got["d1", "cough"].final_weight == pytest.approx(0.215090, abs=1e-6) and got["d1", "headache"].weight_category == "Weak"
    assert got["d2", "cough"].final_weight == pytest.approx(0.386921, abs=1e-6)
    assert got["d3", "nausea"].final_weight == pytest.approx(0.914286, abs=1e-6) and got["d2", "sneezing"].weight_category == "Very Strong"


def test_degenerate_weights(spark):
    one_entity = spark.createDataFrame([("d", "a"), ("d", "b")], "entity_id STRING, feature STRING")
    assert {r.final_weight for r in wt.combined_weights(one_entity).collect()} == {0.0}
    flat = wt.minmax_combined(wt.plain_weights(one_entity)).collect()
    assert all(r.combined_weight == pytest.approx(0.5) for r in flat)


def test_bag_keeps_repeats(spark):
    df = spark.createDataFrame([("d", "D", "A, A ,b")], "disease_id STRING, disease STRING, common_symptom STRING")
    assert sorted(r.feature for r in pr.explode_pairs(df, distinct=False).collect()) == ["A", "A", "b"]


def test_graph_queries(spark, pairs):
    names = pairs.select("entity_id", "entity").distinct()
    ent, feat, edges = [t.cache() for t in gr.build_graph(wt.combined_weights(pairs), names, 0.2)]
    q = spark.createDataFrame([(1, "Fever"), (1, "COUGH"), (2, "unknown")], "query_id LONG, feature STRING")
    ranked = gr.rank_entities(q, ent, feat, edges, min_weight=0.2).collect()
    assert [(r.entity_id, r.matched_count) for r in sorted(ranked, key=lambda r: r["rank"])] == [("d1", 2), ("d2", 1)]
    rel = gr.related_with_additional(q, ent, feat, edges, min_weight=0.2).collect()
    assert {(r.entity_id, r.additional_feature) for r in rel} == {("d1", "Headache"), ("d2", "Sneezing")}
    assert gr.suggestions_json(gr.related_with_additional(q, ent, feat, edges, 0.2)).count() == 2
    stats = {r.metric: r.value for r in gr.graph_statistics(ent, feat, edges).collect()}
    assert stats["entities"] == 3 and stats["features"] == 5 and stats["total_relationships"] == 14
    lst = gr.feature_list_of_entity(gr.features_of_entity(ent, feat, edges, name="FLU", min_weight=0.2)).first()
    assert lst.feature_count == 3 and lst.features[0].feature == "Fever"
    up = gr.upsert_edges(edges, edges.limit(1).withColumn("weight", F.lit(9.0))).collect()
    assert len(up) == 7 and sum(r.weight == 9.0 for r in up) == 1
    ask = spark.createDataFrame([("flu", None), ("flu", "Symptom"), ("x", None)], "name STRING, type STRING")
    nodes = ent.withColumn("type", F.lit("Disease")).unionByName(feat.withColumn("type", F.lit("Symptom")))
    assert {(r.name, r.type): r.valid for r in gr.validate_entities(ask, nodes).collect()} == {("flu", None): True, ("flu", "Symptom"): False, ("x", None): False}
    con = spark.createDataFrame([("d1", "DISEASE"), ("cough", "SYMPTOM")], "concept_id STRING, concept_type STRING")
    assert gr.concept_relationships(con, ent, feat, edges).count() == 5
    assert gr.list_features(feat, 2).count() == 2 and gr.fetch_relations(ent, feat, edges, 0.6).count() == 3


@pytest.mark.parametrize("text, strict, want", [
    ("Shortness of  Breath", True, "shortness breath"), ("Shortness of Breath", False, "dyspnea"),
    ("poor appetite", True, "loss of appetite"), ("loss of appetite", True, "loss appetite"), (" High FEVER ", True, "fever"),
])
def test_normaliser(spark, text, strict, want):
    assert one(spark, lambda c: tx.normalise_feature(c, strict), text) == want


def test_text_functions(spark):
    assert one(spark, tx.display_name, "crohn's low-grade") == "Crohn'S Low-Grade"
    assert one(spark, tx.slug_id, "A b--c!") == "symptom::a_b_c"
    assert one(spark, tx.slug_id, "éè").startswith("symptom::symptom_")
    assert one(spark, tx.clean_corpus_text, " a\n b.....c---d.Next ") == "a b...c--d. Next"
    assert one(spark, tx.clean_document_text, "Été Page 1 of 2 ok* 12") == "Été  ok"
    assert one(spark, tx.document_type, "A Lab Report") == "patient_records" and one(spark, tx.document_type, "x") == "clinical_notes"
    assert one(spark, tx.patient_id, "MRN: A77 patient id 9") == "9" and one(spark, tx.patient_id, "none") is None
    assert str(one(spark, tx.document_date, "Date: 1/31/2024")) == "2024-01-31"
    assert str(one(spark, tx.document_date, "on 2-3-71 then")) == "1971-02-03"
    assert one(spark, tx.document_date, "Date: 31/31/2024") is None
    assert one(spark, tx.expand_query, "Pt, with BP high") == "patient with blood pressure high"
    assert one(spark, tx.topics, "Pain after medication") == ["symptom_pain", "medication_discussion"]
    got = one(spark, tx.parsed_response, "<system>**Clinical Reasoning:**\n a \n\nb**Conclusions:** clearly maybe</system>")
    assert got.reasoning_chain == ["a", "b"] and got.confidence == pytest.approx(0.6) and "consult" in got.response
    assert len(one(spark, lambda c: tx.result_key("ner", c), " Ab ")) == len("medical:ner:") + 16


def test_flatten_record(spark):
    df = spark.sql("SELECT 1 id, 's' split, 'a' t, array('b','c') l, named_struct('text','d','n',1) s, array(named_struct('role','u','content','e')) m, 5 n")
    r = cp.combine_records(df, "id", "split").first()
    assert r.combined_text == "a b c d e" and r.text_length == 9


def test_windows(spark):
    spans = lambda n: [(c.start, c.end) for c in one(spark, lambda c: ck.window_chunks(c), "x" * n)]
    assert spans(2500) == [(0, 1000), (800, 1800), (1600, 2500)] and spans(1000) == [(0, 1000)] and spans(10) == [(0, 10)]
    with pytest.raises(ValueError):
        ck.window_chunks(F.col("x"), 10, 10)


def test_sections_and_paragraphs(spark):
    text = "intro\nDiagnosis:\nflu\nMEDICATIONS \nnone"
    s = one(spark, ck.section_chunks, text)
    assert [(c.section, c.text, c.start, c.end) for c in s] == [("diagnosis", "Diagnosis:\nflu", 6, 21), ("medications", "MEDICATIONS \nnone", 21, 38)]
    assert len(one(spark, lambda c: ck.section_chunks(c, True), text)) == 3
    assert [c.text for c in one(spark, ck.section_chunks, "plain")] == ["plain"]
    para = "aaaa\n\nbbbb\n \ncccc"
    p = one(spark, lambda c: ck.paragraph_chunks(c, 9, 2), para)
    assert [(c.text, c.start, c.end) for c in p] == [("aaaa\n\nbbbb", 0, 10), ("bb\n\ncccc", 13, 17)]
    d = one(spark, lambda c: ck.document_chunks(c, 9, 2), para + " " + "d" * 12)
    assert all(len(c.text) <= 10 for c in d) and d[-1].kind == "window"


def test_overlaps_and_matching(spark):
    spans = spark.createDataFrame([(1, s, e, "X") for s, e in [(0, 5), (0, 9), (4, 12), (9, 11)]], "doc_id INT, start INT, end INT, label STRING")
    assert sorted((r.start, r.end) for r in dc.remove_overlaps(spans).collect()) == [(0, 9), (9, 11)]
    schema = "id STRING, seq INT, text STRING, type STRING, start INT, end INT"
    truth = spark.createDataFrame([("a", 0, "diabetes", "DISEASE", 10, 18), ("a", 1, "chest pain", "SYMPTOM", 30, 40)], schema)
    kinds = lambda rows: sorted(r.kind for r in ev.match_spans(spark.createDataFrame(rows, schema), truth).collect())
    good = [("a", 0, "diabetes", "DISEASE", 10, 18), ("a", 1, "chest pain", "SYMPTOM", 30, 40)]
    assert kinds(good) == ["exact", "exact"]
    m = ev.document_metrics(ev.match_spans(spark.createDataFrame(good, schema), truth)).first()
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (1, 1, 1, 1)
    assert kinds([good[0], ("a", 1, "chest pain", "DISEASE", 30, 40)]) == ["exact", "type_mismatch"]
    assert kinds([good[0], ("a", 1, "pain", "SYMPTOM", 35, 45)]) == ["exact", "partial"]
    assert kinds([("a", 0, "x", "DISEASE", 50, 52)]) == ["missing", "missing", "no_match"]
    report = ev.evaluation_report(ev.match_spans(spark.createDataFrame(good[:1], schema), truth)).collect()
    assert {r.metric: r.value for r in report}["recall"] == 0.5


NAMES = [("s1", "chest pain", "SYMPTOM"), ("s2", "chest pains", "SYMPTOM"), ("d1", "painful chest", "DISEASE"), ("d2", "crohn disease (severe)", "DISEASE"), ("s3", "flu", "SYMPTOM")]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame([(i, n, n.title(), t, k) for k, (i, n, t) in enumerate(NAMES)],
                                 "concept_id STRING, name STRING, display_name STRING, concept_type STRING, load_seq LONG").cache()


def test_candidates(spark, kb):
    got = ln.generate_candidates(spark.createDataFrame([("Chest pain ",), ("(severe)",)], "mention STRING"), kb).orderBy("mention", "rank").collect()
    chest = [r for r in got if r.mention == "chest pain"]
    assert (chest[0].concept_id, chest[0].score, chest[0].stage) == ("s1", 1.0, "exact")
    assert (chest[1].concept_id, chest[1].stage) == ("s2", "fuzzy")
    alias = [r for r in got if r.mention == "(severe)"]
    assert (alias[0].concept_id, alias[0].score) == ("d2", 0.9)


def test_fuzzy_equals_brute_force(spark, kb):
    import random

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(2, 14))).strip() or "a" for _ in range(150)})
    left, right = words[:60], words[60:]
    m = spark.createDataFrame([(w,) for w in left], "mention STRING")
    n = spark.createDataFrame([(w,) for w in right], "name STRING")
    got = {(r.mention, r.name) for r in ln.fuzzy_pairs(m, n).collect()}
    want = {(a, b) for a in left for b in right if 0.7 <= SequenceMatcher(None, a, b).ratio() < 1}
    assert got == want and want
    got = {(r.mention, r.name) for r in ln.containment_pairs(m, n, 0.3).collect()}
    assert got == {(a, b) for a in left for b in right if min(len(a), len(b)) >= 3 and (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b)) >= 0.3}


def test_extraction_equals_brute_force(spark, kb):
    texts = ["A painful chest, then CHEST PAINS.", "flu", "influenza flu", "nothing", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = {(i, n) for i, t in enumerate(texts) for _, n, _ in NAMES if n in t.lower()}
    for limit in (100_000, 0):  # broadcast dictionary and shuffled dictionary
        assert {(r.doc_id, r.name) for r in dc.find_names(docs, kb, broadcast_bytes=limit).collect()} == want
    assert dc.find_names(docs, kb.limit(0)).count() == 0
    assert dc.find_names(docs.limit(0), kb).count() == 0
    bounded = {(r.doc_id, r.name, r.start) for r in dc.find_names(docs, kb, word_bounded=True).collect()}
    assert (2, "flu", 10) in bounded and (0, "chest pain", 22) not in {(a, b, c) for a, b, c in bounded}
    linked = ln.link_documents(docs, kb)
    assert {(r.doc_id, r.concept_id) for r in linked.collect()} >= {(0, "d1"), (1, "s3")}
    ann = dc.annotate(docs, kb)
    labels = cp.bio_labels(ann)
    spans = cp.decode_bio(labels.withColumn("confidence", F.lit(1.0)), ann)
    assert {(r.id, r.text) for r in spans.collect()} >= {("0", "painful chest"), ("1", "flu")}
    hits = ev.simple_hits(ln.predictions(docs, linked), ann).first()
    assert hits.recall == 1.0
    assert cp.ranking_rows(ann).count() == hits.total_true
    assert ev.entity_totals(ln.predictions(docs, linked), ann).first().true == hits.total_true


def test_exact_ranks(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("g"), (F.col("id") * 0.1).alias("v")).unionByName(
        spark.range(1000).select(F.lit("b").alias("g"), F.pmod(F.col("id") * 37, F.lit(11)).cast("double").alias("v")))
    t = {"p95": od.nearest_rank(95), "p99": od.nearest_rank(99), "m0": od.median_low, "m1": od.median_high}
    got = {r.g: r for r in od.exact_ranks(df, ["g"], "v", t).collect()}
    assert got["a"].p95 == pytest.approx(2.0) and got["a"].p99 == pytest.approx(2.0) and (got["a"].m0 + got["a"].m1) / 2 == pytest.approx(1.05)
    b = sorted((i * 37) % 11 for i in range(1000))
    assert got["b"].p95 == b[950] and got["b"].m0 == b[499]


def test_exact_ranks_narrow_wide_brackets(spark, monkeypatch):
    df = spark.range(1_000_000).select(
        F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double").alias("v"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"))
    widest = []
    narrowed = od._narrowed

    def watched(hits, g, accuracy, limit):
        out = narrowed(hits, g, accuracy, limit)
        count = lambda h: h.groupBy(*g, "_target").count().agg(F.max("count")).first()[0]
        widest.append((count(hits), count(out)))
        return out

    monkeypatch.setattr(od, "_narrowed", watched)
    targets = {"p95": od.nearest_rank(95), "m": od.median_low, "first": lambda n: n * 0, "last": lambda n: n - 1}
    got = {r.g: r for r in od.exact_ranks(df, ["g"], "v", targets, limit=1000).collect()}
    assert widest[0][0] > 1000 >= widest[0][1]
    for g, ids in (("hot", [i for i in range(1_000_000) if i % 3]), (None, range(0, 1_000_000, 3))):
        v = sorted(i * 7919 % 1_000_003 for i in ids)
        n = len(v)
        assert (got[g].n, got[g].p95, got[g].m, got[g].first, got[g]["last"]) == (n, v[int(0.95 * n)], v[(n - 1) // 2], v[0], v[-1])
    assert od.exact_ranks(df.limit(0), ["g"], "v", targets).count() == 0


def test_turns_before_a_question(spark):
    said = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)] + [(2, 0, "user", None), (None, 0, "user", "lost")]
    messages = spark.createDataFrame(said, "conv_id LONG, turn LONG, role STRING, text STRING")
    asked = [("a", 1, 4, "q"), ("b", 1, 99, "q"), ("c", 1, 0, "q"), ("d", 2, 1, "q"), ("e", None, 3, "q"), ("f", 9, 3, "q"), ("g", 1, 4, "q")]
    queries = spark.createDataFrame(asked, "query_id STRING, conv_id LONG, turn LONG, text STRING")
    got = {r.query_id: r.earlier for r in cv.turns_before(queries, messages).collect()}
    assert got == {"a": ["assistant: m1", "user: m2", "assistant: m3"], "b": ["user: m4", "assistant: m5", "user: m6"], "d": ["user: "],
                   "g": ["assistant: m1", "user: m2", "assistant: m3"]}
    findings = spark.createDataFrame([("a", "flu")], "query_id STRING, findings STRING")
    prompts = {r.query_id: r.prompt for r in cv.prompt_parts(queries, messages, findings).collect()}
    assert len(prompts) == 7 and "m3" in prompts["a"] and "flu" in prompts["a"] and "m4" not in prompts["a"] and "Earlier" not in prompts["e"]


def test_questions_with_filters_of_their_own(spark):
    chunks = spark.createDataFrame(
        [("x", 1, "fever cough alpha", {"patient_id": "p1"}), ("y", 2, "fever cough alpha", {"patient_id": "p2"}), ("y", 3, "fever cough alpha", None),
         (None, 4, "fever cough alpha", {"patient_id": "p1"}), ("x", 5, "other words", {}), ("x", 6, "more of them", {})],
        "collection STRING, chunk_id LONG, text STRING, metadata MAP<STRING, STRING>")
    asked = [(1, "fever cough", None, None), (2, "fever cough", ["y"], None), (3, "fever cough", None, {"patient_id": "p1"}),
             (4, "fever cough", ["y"], {"patient_id": "p2"}), (5, "fever cough", [], None)]
    queries = spark.createDataFrame(asked, "query_id LONG, text STRING, collections ARRAY<STRING>, wanted MAP<STRING, STRING>")
    got = {}
    for r in rt.retrieve(queries, chunks).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {1, 2, 3, 4}, 2: {2, 3}, 3: {1, 4}, 4: {2}}


def test_positions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("g"))
    got = od.dense_index(df.repartition(7), ["id"], "i").collect()
    assert all(r.i == r.id for r in got)
    rn = od.spread_row_number(df, ["g"], F.floor(F.col("id") / 30), ["id"], "n").collect()
    assert all(r.n == r.id // 2 + 1 for r in rn)


EVIDENCE = [(1, 0, "neural", "a", 0.9, 0.8, 0.3), (1, 0, "neural", "b", 0.6, 0.8, 0.3), (1, 1, "symbolic", "a", 0.7, 0.6, 0.2)]


def test_fusion(spark):
    e = spark.createDataFrame(EVIDENCE, "query_id LONG, seq INT, source_type STRING, entity STRING, p DOUBLE, confidence DOUBLE, uncertainty DOUBLE")
    src = fu.sources(e, fu.default_reliability(spark))
    w = {r.source_type: r.weight for r in src.collect()}
    assert w["neural"] == pytest.approx(0.590560, abs=1e-6) and sum(w.values()) == pytest.approx(1)
    f = {r.entity: r for r in fu.fuse_weighted(e, src).collect()}
    assert f["a"].confidence == pytest.approx(0.762442, abs=1e-6) and f["a"].uncertainty == pytest.approx(0.259056, abs=1e-6)
    assert f["b"].confidence == pytest.approx(0.575) and f["b"].uncertainty == pytest.approx(0.3)
    q = spark.createDataFrame([(1,), (2,)], "query_id LONG")
    o = {r.query_id: r for r in fu.overall(fu.fuse_weighted(e, src), src, q).collect()}
    assert o[1].overall_confidence == pytest.approx(0.718105, abs=1e-6) and o[1].overall_uncertainty == pytest.approx(0.189304, abs=1e-6)
    assert (o[2].overall_confidence, o[2].overall_uncertainty) == (0.0, 1.0)
    b = {r.entity: r.confidence for r in fu.fuse(e, fu.default_reliability(spark), "bayesian").collect()}
    assert b["a"] == pytest.approx(0.954545, abs=1e-6) and b["b"] == pytest.approx(0.6)
    assert len(fu.reasoning_chain(src).first().steps) == 5


def test_reliability_average(spark):
    rows = [("neural", 1, "x", 0.9, True), ("neural", 2, "x", 0.9, False), ("neural", 3, "x", 0.9, True)]
    fb = spark.createDataFrame(rows, "source_type STRING, batch INT, entity STRING, p DOUBLE, truth BOOLEAN")
    got = {r.source_type: r for r in fu.update_reliability(fu.default_reliability(spark), fb).collect()}
    assert got["neural"].accuracy == pytest.approx(0.800650) and got["rag"].accuracy == pytest.approx(0.70)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_reliability_blocks_equal_the_fold(spark, block):
    rows = [(s, b, "x", 0.9 if (b * k) % 5 else 0.1, b % k > 0) for k, s in ((2, "neural"), (3, "new")) for b in range(3, 60, k) for _ in range(2)]
    rows += [("rag", None, "x", 0.9, True)]
    fb = spark.createDataFrame(rows, "source_type STRING, batch INT, entity STRING, p DOUBLE, truth BOOLEAN")
    start = {r.source_type: r.accuracy for r in fu.default_reliability(spark).collect()}
    want = {s: start.get(s, 0.5) for s in ("neural", "new", "rag")}
    for r in sorted(fu.feedback_confusion(fb).collect(), key=lambda r: r.batch or 0):
        want[r.source_type] += fu.LEARNING_RATE * (r.accuracy - want[r.source_type])
    got = {r.source_type: r.accuracy for r in fu.update_reliability(fu.default_reliability(spark), fb, block=block).collect()}
    assert {s: got[s] for s in want} == pytest.approx(want)


def test_safety(spark):
    rows = [(1, "You have a rare disease. Take 5 mg now.", [("chest_pain", "SYMPTOM")], 0.9, 0.2, False), (2, "Rest well.", [], 0.99, 0.1, False),
            (3, "Rest well.", [("flu", "DISEASE")], 0.6, 0.6, True)]
    df = spark.createDataFrame(rows, "query_id LONG, response STRING, entities ARRAY<STRUCT<concept_name: STRING, concept_type: STRING>>, confidence DOUBLE, uncertainty DOUBLE, contradictory BOOLEAN")
    got = {r.query_id: r for r in sf.sanitize(sf.assess(df)).collect()}
    assert set(got[1].flags) == {"diagnosis_claim", "treatment_advice", "emergency_symptoms"} and got[1].risk_level == "critical" and got[1].human_review_required
    assert got[1].flag_hits["diagnosis_claim"] == 2 and "disease" not in got[1].sanitized.split("\n\n")[1]
    assert got[2].risk_level == "low" and got[2].flags == [] and got[2].confidence_override is None
    assert got[3].confidence_override == pytest.approx(0.0) and got[3].risk_level == "moderate" and len(got[3].disclaimers) == 3
    off = {r.query_id: r for r in sf.assess(df, sf.SafetyLimits(detect_emergencies=False, human_review=False, require_disclaimers=False)).collect()}
    assert off[1].risk_level == "high" and not off[1].human_review_required and off[1].disclaimers == []
    assert one(spark, lambda c: sf.threshold_warnings(F.lit(0.5), F.lit(0.75)), "x").__len__() == 3


def test_retrieval(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id LONG, embedding ARRAY<DOUBLE>")
    c = spark.createDataFrame([("a", 10, [0.5, math.sqrt(0.75)]), ("a", 11, [0.4, math.sqrt(0.84)]), ("b", 12, [1.0, 0.0])],
                              "collection STRING, chunk_id LONG, embedding ARRAY<DOUBLE>")
    for limit in (rt.CHUNK_ROWS, 1):
        got = rt.search_vectors(q, c, chunk_rows=limit).orderBy("rank").collect()
        assert [(r.chunk_id, round(r.distance, 9)) for r in got] == [(12, 0.0), (10, 1.0)]
    docs = spark.createDataFrame([("c", 1, "red fox jumps", {"patient_id": "p"}), ("c", 2, "blue whale", {}), ("e", 3, "green tree frog", {})],
                                 "collection STRING, chunk_id LONG, text STRING, metadata MAP<STRING,STRING>")
    ask = spark.createDataFrame([(1, "Red fox"), (2, "zzz")], "query_id LONG, text STRING")
    found = rt.retrieve(ask, docs)
    assert [(r.query_id, r.chunk_id) for r in found.collect()] == [(1, 1)]
    ctx = {r.query_id: r for r in rt.response_context(found, ask).collect()}
    assert "(Patient: p)" in ctx[1].context and ctx[2].total_results == 0
    assert rt.restrict(docs, ["c"], {"patient_id": "p"}).count() == 1
    rows = dm.collection_rows(ck.chunk_rows(docs.withColumn("m", F.create_map(F.lit("document_type"), F.lit("disease_info"))), ck.document_chunks(F.col("text")), "chunk_id", "m"))
    assert {r.collection for r in rows.collect()} == {"disease_info"}


def test_splits_and_encounters(spark):
    df = spark.range(1001).select(F.col("id"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("label"))
    n = {r.part: r["count"] for r in sp.split_exact(df, "id", 0.2).groupBy("part").count().collect()}
    assert n == {"train": 800, "test": 201}
    s = {(r.label, r.part): r["count"] for r in sp.split_stratified(df, "id", "label").groupBy("label", "part").count().collect()}
    assert s["hot", "train"] == 630 and s["hot", "val"] == 135 and s["hot", "test"] == 135 and s["cold", "train"] == 70
    lead = sp.split_leading(df, "id").where("part = 'train'").agg(F.max("id"), F.count("*")).first()
    assert tuple(lead) == (799, 800)
    rel = spark.range(12).select((F.col("id") % 3).alias("entity_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("feature_id"), (F.col("id") / 12).alias("weight"))
    enc = sp.simulate_encounters(rel, 5).cache()
    pos = enc.where("polarity = 'positive'").groupBy("encounter_id").count().collect()
    assert len(pos) == 15 and all(r["count"] >= 2 for r in pos)
    assert enc.groupBy("encounter_id", "feature_id").count().where("count > 1").count() == 0
    vocab = pd_.feature_vocabulary(rel)
    assert [r.idx for r in vocab.orderBy("feature_id").collect()] == list(range(1, 13))
    assert pd_.padded_ids(enc, vocab).select(F.size("ids").alias("n")).distinct().count() == 1
    top = pd_.predict_top_k(spark.createDataFrame([("c1", "f11"), ("c2", "zz")], "case_id STRING, feature_id STRING"), rel, pd_.label_vocabulary(rel), 2).collect()
    assert [(r.entity_id, r.warning) for r in sorted(top, key=lambda r: (r.case_id, r["rank"]))] == [(2, None), (0, "no known feature"), (1, "no known feature")]
    emb = spark.createDataFrame([("f1", [1.0, 2.0])], "feature_id STRING, embedding ARRAY<DOUBLE>")
    assert pd_.align_embeddings(vocab, emb, 2).where("embedding[0] = 0").count() == 11


def test_walks(spark):
    rel = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.3), (2, "b", 1.0)], "entity_id INT, feature_id STRING, weight DOUBLE")
    walks = wk.random_walks(rel, num_walks=300, length=3).cache()
    assert walks.count() == 4 * 300 and {len(r.path) for r in walks.collect()} == {3}
    ok = {("d::1", "s::a"), ("d::1", "s::b"), ("d::2", "s::b")}
    ok |= {(b, a) for a, b in ok}
    assert all((r.path[i], r.path[i + 1]) in ok for r in walks.collect() for i in range(2))
    share = walks.where("start = 'd::1'").agg(F.avg((F.col("path")[1] == "s::a").cast("double"))).first()[0]
    assert 0.6 < share < 0.8
    assert wk.node_embeddings(walks, dim=4).count() == 4
    assert wk.node_embeddings(walks, dim=4).where(F.size("embedding") == 4).count() == 4


def test_memo(spark):
    at = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    req = spark.createDataFrame([("A ",), ("a",), ("bb",)], "input STRING")
    empty = spark.createDataFrame([], "component STRING, key_hash STRING, input STRING, result STRING, stored_at TIMESTAMP, hits LONG")
    up = lambda m: m.withColumn("result", F.upper("input"))
    first, store = mm.reuse(req, empty, "c", up, at)
    assert first.where("hit").count() == 0 and store.count() == 2
    second, store2 = mm.reuse(req, store, "c", up, at)
    assert second.where("hit").count() == 3 and store2.agg(F.sum("hits")).first()[0] == 3
    assert mm.reuse_statistics(second).first().hit_rate == 1.0
    assert mm.fresh(store, F.to_timestamp(F.lit("2024-01-03 12:00:00")), 3600).count() == 0
    assert mm.invalidate(store, "c").count() == 0 and mm.invalidate(store, pattern="medical:x:%").count() == 2


def test_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "bot", f"message {t}") for t in range(8)]
    m = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    assert cv.latest(m, 9).first().latest == "message 7" and cv.last_messages(m, 5).count() == 5
    ents = spark.createDataFrame([(1, 0, "x", 0.1), (1, 1, "y", 0.2), (1, 2, "x", 0.3), (1, 5, "x", 0.4), (1, 6, "x", 0.5)], "conv_id LONG, turn_no LONG, entity STRING, confidence DOUBLE")
    t = {r.entity: r for r in cv.entity_timeline(ents).collect()}
    assert t["x"].confidence_trend == [0.3, 0.4, 0.5] and (t["x"].first_mention, t["x"].last_mention) == (0, 6)
    assert {(r.turn_no, r.past_turn) for r in cv.relevant_turns(ents).collect()} == {(2, 0), (5, 2), (6, 5)}


def test_dashboard_status(spark):
    p = spark.sql("SELECT timestamp'2024-01-01 00:00:00' ts, 'a' component, 0.4 duration, true success")
    none = spark.sql("SELECT timestamp'2024-01-01 00:00:00' ts, 'q' query_type, 1 entities_found, 0.9D confidence, 0.1D uncertainty, array('f') safety_flags")
    err = spark.createDataFrame([], "ts TIMESTAMP, component STRING, error_type STRING, error_message STRING")
    d = mo.dashboard(p.withColumn("duration", F.col("duration").cast("double")), none, err).first()
    assert d.system_overview.system_status == "healthy" and d.response_times[0].n == 1 and d.safety_flags[0].times == 1
    gone = mo.system_overview(p.limit(0), none, err, F.to_timestamp(F.lit("2024-01-02 00:00:00"))).first()
    assert gone.system_status == "unknown"


def test_no_cartesian_product(spark, pairs):
    for df in (wt.combined_weights(pairs), mo.performance_summary(spark.sql("SELECT 'a' component, 1.0D duration, true success"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_span_matching_equals_a_plain_fold(spark):
    import random

    rng = random.Random(11)

    def plain(p, t):
        used, out = set(), []
        for a in sorted(p):
            best = None
            for j, b in enumerate(sorted(t)):
                common = min(a[4], b[4]) - max(a[3], b[3])
                if common > 0 and j not in used:
                    overlap = common / max(a[4] - a[3], b[4] - b[3])
                    if best is None or overlap > best[0]:
                        best = (overlap, j)
            if best is None:
                out.append(("no_match", a[0], None))
                continue
            used.add(best[1])
            b = sorted(t)[best[1]]
            out.append(("partial" if best[0] < 0.8 else "exact" if a[2] == b[2] else "type_mismatch", a[0], b[0]))
        return out + [("missing", None, b[0]) for j, b in enumerate(sorted(t)) if j not in used]

    def spans(n, width):
        rows = []
        for k in rng.sample(range(1000), n):
            begin = rng.randrange(120)
            rows.append((k, "x", rng.choice("AB"), begin, begin + rng.randrange(width)))  # empty spans too
        return rows

    docs = {f"d{i}": (spans(rng.randrange(0, 14), 12 if i % 2 else 40), spans(rng.randrange(0, 14), 12)) for i in range(40)}
    docs["far"] = ([(i, "x", "A", 10 * i, 10 * i + 5) for i in range(400)], [(i, "x", "A", 10 * i + 1, 10 * i + 5) for i in range(0, 400, 2)])
    schema = "id STRING, seq INT, text STRING, type STRING, start INT, end INT"
    frame = lambda side: spark.createDataFrame([(i, *s) for i, both in docs.items() for s in both[side]], schema)
    got = sorted(((r.id, r.kind, r.pred and r.pred.seq, r.truth and r.truth.seq) for r in ev.match_spans(frame(0), frame(1)).collect()), key=repr)
    assert got == sorted(((i, *m) for i, (p, t) in docs.items() for m in plain(p, t)), key=repr)
    only = ev.match_spans(frame(0), frame(1), spark.createDataFrame([("far",), ("far",), (None,)], "id STRING"))
    assert only.groupBy("kind").count().count() == 2 and only.select("id").distinct().count() == 1


def test_run_filter_passes_every_name_and_few_others(spark, monkeypatch):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé\U0001F600") for _ in range(n))
    known = sorted({word(rng.randint(3, 12)) for _ in range(300)})
    kb = spark.createDataFrame([(f"c{i}", n, n, "T", i) for i, n in enumerate(known)],
                               "concept_id STRING, name STRING, display_name STRING, concept_type STRING, load_seq LONG")
    texts = [None, "", "ab", known[0]] + [" ".join(rng.choice(known) if rng.random() < 0.1 else word(7) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = {(i, n, t.index(n)) for i, t in enumerate(texts) if t for n in known if n in t}
    # slices shorter than a name: runs that cross a border are found all the same
    monkeypatch.setattr(dc, "SLICE", 5)
    for limit in (1 << 20, 0):
        assert {(r.doc_id, r.name, r.start) for r in dc.find_names(docs, kb, broadcast_bytes=limit).collect()} == want
    monkeypatch.undo()
    keyed = dc.with_run(kb).select("anchor", "name")
    lookup, power = dc.run_filter(keyed, len(known))
    passed = docs.select("doc_id", F.explode(dc.run_codes(lookup, power)("text")).alias("anchor"))
    true = passed.join(keyed.select("anchor").distinct(), "anchor", "left_semi").count()
    assert true <= passed.count() <= 1.1 * true


def test_labels_in_the_row_equal_a_plain_pass(spark):
    kind = "array<struct<entity:string,display_name:string,position:int>>"
    a = lambda *named: [(n, n, p) for n, p in named]
    given = [
        ("1", "Flu, then chest  pain\nand flu-like fever.", a(("chest  pain", 0), ("flu", 20)), a(("pain", 11), ("ever", 0), ("absent", 3))),
        ("2", "\U0001F600 é flu", a(("flu", 0)), None), ("3", "", [], []), ("4", None, None, None), ("5", "plain words", None, []),
        ("6", "painkiller", a(("pain", 0)), a(("killer", 4))), ("7", "a flu", [(None, None, 1), ("flu", "flu", None), ("flu", "flu", 0)], []),
    ]
    df = spark.createDataFrame(given, f"id STRING, text STRING, diseases {kind}, symptoms {kind}")

    def plain(text, diseases, symptoms):
        spans = [(max(text.find(n, p), p), n, l) for named, l in ((diseases, "DISEASE"), (symptoms, "SYMPTOM")) for n, _, p in named or []
                 if n is not None and p is not None]
        for k, m in enumerate(re.finditer(r"\w+|[^\w\s]", text or "")):
            over = [(s, l) for s, n, l in spans if s < m.end() and s + len(n) > m.start()]
            label = "O" if not over else ("B-" if m.start() <= over[-1][0] else "I-") + over[-1][1]
            yield k, m.group(), m.start(), m.end(), label

    want = {(i, *row) for i, t, d, s in given for row in plain(t, d, s)}
    got = cp.bio_labels(df).select("id", "token_index", "token", "start", "end", "label")
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r)[:5] for r in cp.tokens_with_offsets(df).select("id", "token_index", "token", "start", "end").collect()} == {w[:5] for w in want}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_decoding_closes_spans(spark):
    marks = ["I-A", "B-A", "I-B", "I-A", "O", "I-A", "B-B", "B-B", "I-B"]
    rows = [("x", i, 2 * i, 2 * i + 1, m, 0.1 * i) for i, m in enumerate(marks)]
    tokens = spark.createDataFrame(rows, "id STRING, token_index INT, start INT, end INT, label STRING, confidence DOUBLE")
    text = spark.createDataFrame([("x", "a b c d e f g h i"), ("y", "no tokens")], "id STRING, text STRING")
    got = {(r.id, r.start, r.end, r.label, r.text, round(r.confidence, 6)) for r in cp.decode_bio(tokens, text).collect()}
    assert got == {("x", 2, 7, "A", "b c d", 0.3), ("x", 12, 13, "B", "g", 0.6), ("x", 14, 17, "B", "h i", 0.8)}
