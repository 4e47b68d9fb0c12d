"""Registered queries on sampling, prediction, walks and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import conversation as cv
from evigraph.operators import predict as pd_
from evigraph.operators import retrieval as rt
from evigraph.operators import sampling as sp
from evigraph.operators import walks as wk
from evigraph.operators import evaluate as ev
from evigraph.operators import weights as wt
from evigraph.functions import text as tx
from evigraph.operators import fusion as fu
from evigraph.operators import graph as gr
from evigraph.plans import answering
from evigraph.plans import queries_text as qt
from evigraph.plans import queries_weights as qw
from evigraph.plans.tables import pair_bag, rnd, rounded, table
from evigraph.session import cut_lineage


def relations(spark, sf_dir, minimum: float = 0.4) -> DataFrame:
    """Weighted relations at or above a minimum, the weight rounded so that ties are ties everywhere."""
    w = wt.combined_weights(pair_bag(spark, sf_dir)).where(F.col("final_weight") >= minimum)
    return cut_lineage(w.select("entity_id", tx.slug_id(F.col("feature")).alias("feature_id"), rnd("final_weight").alias("weight")))


def split_exact(spark, sf_dir):
    return sp.split_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def split_stratified(spark, sf_dir):
    return sp.split_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


def split_leading(spark, sf_dir):
    return sp.split_leading(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def encounters(spark, sf_dir):
    return sp.simulate_encounters(relations(spark, sf_dir))


def encounters_simple(spark, sf_dir):
    return sp.simple_encounters(relations(spark, sf_dir))


def encounters_nested(spark, sf_dir):
    out = sp.nest_encounters(sp.simulate_encounters(relations(spark, sf_dir)))
    return out.select("encounter_id", "entity_id", F.array_join("positive_symptoms", ",").alias("positive"), F.array_join("negative_symptoms", ",").alias("negative"))


def vocab_index(spark, sf_dir):
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return pd_.feature_vocabulary(table(spark, sf_dir, "documents").select(words.alias("feature_id")).where(F.col("feature_id") != ""))


def label_index(spark, sf_dir):
    return pd_.label_vocabulary(relations(spark, sf_dir))


def padded_ids(spark, sf_dir):
    enc = sp.simple_encounters(relations(spark, sf_dir))
    vocabulary = pd_.feature_vocabulary(enc.where(F.col("polarity") == "positive"))
    out = pd_.padded_ids(enc, vocabulary)
    return out.select("encounter_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def bag_rows(spark, sf_dir):
    enc = sp.simple_encounters(relations(spark, sf_dir))
    return pd_.bag_rows(enc, pd_.feature_vocabulary(relations(spark, sf_dir)))


def cases(spark, sf_dir) -> DataFrame:
    """Suppliers as cases with their most frequent part names; a nation's name is an unknown feature."""
    known = qw.feature_queries(spark, sf_dir).select(F.col("query_id").alias("case_id"), tx.slug_id(F.col("feature")).alias("feature_id"))
    unknown = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("case_id"), tx.slug_id(F.col("n_name")).alias("feature_id"))
    return known.unionByName(unknown)


def graph_prior_scores(spark, sf_dir):
    return rounded(pd_.prior_scores(cases(spark, sf_dir), relations(spark, sf_dir, 0.3)), "score", places=4)


def predict_topk(spark, sf_dir):
    rel = relations(spark, sf_dir, 0.3)
    return rounded(pd_.predict_top_k(cases(spark, sf_dir), rel, pd_.label_vocabulary(rel)), "probability")


def classifier_metrics(spark, sf_dir):
    """Market segment of a customer from the part names it ordered."""
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("label"))
    rows = wt.pair_counts(pair_bag(spark, sf_dir)).join(segments, "entity_id")
    parts = sp.split_exact(segments.select("entity_id"), "entity_id", 0.3)
    data = cut_lineage(rows.join(parts, "entity_id").select(F.col("entity_id").alias("case_id"), "label", F.col("feature").alias("feature_id"), "part"))
    ranked = pd_.bag_classifier(data.where(F.col("part") == "train").drop("part"), data.where(F.col("part") == "test").drop("part"))
    first = ev.classification_metrics(ranked.where(F.col("rank") == 1), "label", "prediction")
    top = ev.top_k_accuracy(ranked, "label", "prediction").drop("n")
    return rounded(first.withColumn("_t", top.select(F.struct("*")).scalar()).select("*", "_t.*").drop("_t"),
                   "accuracy", "f1_macro", "f1_weighted", "top1_accuracy", "top3_accuracy", "top5_accuracy")


def prior_metrics(spark, sf_dir):
    """Top-k accuracy of the graph prior on simulated cases."""
    rel = relations(spark, sf_dir)
    enc = sp.simulate_encounters(rel).where(F.col("polarity") == "positive")
    ranked = pd_.predict_top_k(enc.select(F.col("encounter_id").alias("case_id"), "feature_id"), rel, pd_.label_vocabulary(rel))
    truth = enc.select(F.col("encounter_id").alias("case_id"), F.col("entity_id").alias("label")).distinct()
    return rounded(ev.top_k_accuracy(ranked.join(truth, "case_id")), "top1_accuracy", "top3_accuracy", "top5_accuracy")


def random_walks(spark, sf_dir):
    w = wk.random_walks(relations(spark, sf_dir))
    return w.select("start", "walk", F.array_join("path", " ").alias("path"))


def node_embeddings(spark, sf_dir):
    w = cut_lineage(wk.random_walks(relations(spark, sf_dir)))
    e = wk.node_embeddings(w)
    return e.select("kind", "node", F.size("embedding").alias("dim"))


def label_centroids(spark, sf_dir) -> DataFrame:
    """Unit mean vector of every label as a search vector."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    # one entry per vector position
    return means.join(norm, "label").groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("m") / F.col("l")).alias("v")))), lambda s: s["v"]).alias("embedding"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("collection"), F.col("vec_id").alias("chunk_id"), "embedding")


def vector_topk(spark, sf_dir):
    return rounded(rt.search_vectors(label_centroids(spark, sf_dir), vectors(spark, sf_dir), threshold=-1.0), "distance")


def vector_topk_cosine(spark, sf_dir):
    return rounded(rt.search_vectors(label_centroids(spark, sf_dir), vectors(spark, sf_dir), n_results=10, threshold=0.2, metric="cosine"), "distance")


def vector_topk_blocks(spark, sf_dir):
    """The same search in many small blocks."""
    return rounded(rt.search_vectors(label_centroids(spark, sf_dir), vectors(spark, sf_dir), threshold=-1.0, query_rows=3, chunk_rows=150), "distance")


def retrieve_dense(spark, sf_dir):
    """Label centroids as questions against documents that have a supplied vector."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.create_map(F.lit("source_file"), F.col("source")).alias("metadata"))
    found = rt.retrieve_dense(label_centroids(spark, sf_dir), vectors(spark, sf_dir).join(docs, "chunk_id"), threshold=-1.0)
    return rounded(found.select("query_id", "rank", "chunk_id", "collection", "relevance_score", "source_file"), "relevance_score")


def document_chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("collection"), F.col("doc_id").alias("chunk_id"), "text",
        F.create_map(F.lit("source_file"), F.col("source"), F.lit("document_id"), F.col("doc_id").cast("string")).alias("metadata"))


def passages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def retrieve_documents(spark, sf_dir):
    out = rt.retrieve(passages(spark, sf_dir), document_chunks(spark, sf_dir))
    return out.select("query_id", "rank", "chunk_id", "collection", rnd("relevance_score").alias("relevance_score"), "source_file")


def retrieve_filtered(spark, sf_dir):
    """Every passage with filters of its own: two languages, one source, both or none."""
    k = F.col("query_id")
    asked = passages(spark, sf_dir).select(
        "*", F.when(k % 2 == 0, F.array(F.lit("en"), F.lit("de"))).alias("collections"),
        F.when(k % 3 == 0, F.create_map(F.lit("source_file"), F.concat(F.lit("src"), (k % 20).cast("string")))).alias("wanted"))
    out = rt.retrieve(asked, document_chunks(spark, sf_dir))
    return out.select("query_id", "rank", "chunk_id", "collection", rnd("relevance_score").alias("relevance_score"), "source_file")


def earlier_turns(spark, sf_dir):
    """Every user turn of all conversations as a question with the three messages before it."""
    messages = table(spark, sf_dir, "conversations")
    asked = messages.where(F.col("role") == "user").select(F.struct("conv_id", "turn").alias("query_id"), "conv_id", "turn")
    out = cv.turns_before(asked, messages)
    return out.select("query_id.conv_id", "query_id.turn", F.size("earlier").alias("n"), F.array_join("earlier", "\n").alias("earlier"))


def retrieve_context(spark, sf_dir):
    found = rt.retrieve(passages(spark, sf_dir), document_chunks(spark, sf_dir), collections=["en", "de"])
    return rt.response_context(found, passages(spark, sf_dir))


def benchmark_graph(spark, sf_dir):
    """Graph over the benchmark dictionary: passages as entities, their long words as features."""
    names = qt.benchmark_names(spark, sf_dir)
    base = table(spark, sf_dir, "benchmark")
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    pairs = base.select(F.col("item_id").alias("entity_id"), words.alias("feature")).where(F.char_length("feature") >= 7)
    titles = base.select(F.col("item_id").alias("entity_id"), F.concat(F.lit("passage "), F.col("item_id").cast("string")).alias("entity"))
    return cut_lineage(names), gr.build_graph(wt.combined_weights(pairs), titles, 0.2)


def answer_batch(spark, sf_dir):
    """Every benchmark passage asked as a question against the documents and the passage graph."""
    names, (entities, features, edges) = benchmark_graph(spark, sf_dir)
    know = answering.Knowledge(names, entities, features, edges, document_chunks(spark, sf_dir), fu.default_reliability(spark))
    # a passage is asked in the conversation of its number after that one's fourth message, every other one of two languages only
    asked = passages(spark, sf_dir).select(
        "*", F.col("query_id").alias("conv_id"), F.lit(4).cast("long").alias("turn"),
        F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"), F.lit("de"))).alias("collections"))
    out = answering.answer(asked, know, history=table(spark, sf_dir, "conversations"))
    return rounded(out, "confidence", "uncertainty", "confidence_override")


# --- SQL counterparts -------------------------------------------------------------------------

def _h(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def _u(stage: str) -> str:
    return "(" + _h("42", f"'{stage}'", "entity_id", "idx", "feature_id") + "::DOUBLE / 1152921504606846976)"


def _rel(minimum: float) -> str:
    return qw.COMBINED + f""",
rel AS (SELECT entity_id, 'symptom::' || replace(feature, ' ', '_') AS feature_id, round(w + 1e-9, 6) AS weight FROM weighted WHERE w >= {minimum})"""


SIMPLE = _rel(0.4) + f""",
sh AS (SELECT entity_id, idx, feature_id, {_h('42', 'entity_id', 'idx', 'feature_id')} AS h FROM rel, range(50) t(idx)),
sr AS (SELECT *, row_number() OVER (PARTITION BY entity_id, idx ORDER BY h, feature_id) AS r FROM sh),
sn AS (SELECT *, count(*) OVER (PARTITION BY entity_id, idx) AS n FROM sr WHERE r <= 5),
simple AS (SELECT entity_id || '_' || lpad(idx::VARCHAR, 4, '0') AS encounter_id, entity_id, idx, feature_id,
    CASE WHEN r <= greatest(1, n // 2) THEN 'positive' ELSE 'negative' END AS polarity FROM sn)"""

ENC = _rel(0.4) + f""",
hv AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, feature_id) <= 3 AS heavy,
    row_number() OVER (PARTITION BY entity_id ORDER BY {_h('42', "'sample'", 'entity_id', 'feature_id')}, feature_id) <= 2 AS sampled FROM rel),
dr AS (SELECT *, {_u('keep')} < least(0.95, weight * 1.5) AS keep, {_u('drop')} > 0.15 AS stay, {_u('noise')} < 0.1 AS noise FROM hv, range(70) t(idx)),
ct AS (SELECT *, count(*) FILTER (keep) OVER w AS n1, count(*) FILTER (keep AND stay) OVER w AS nk, count(*) FILTER (heavy AND stay) OVER w AS nh
    FROM dr WINDOW w AS (PARTITION BY entity_id, idx)),
ps AS (SELECT *, CASE WHEN CASE WHEN n1 < 2 THEN nh ELSE nk END < 2 THEN sampled ELSE CASE WHEN n1 < 2 THEN heavy ELSE keep END AND stay END AS pos FROM ct),
enc AS (SELECT entity_id || '_' || lpad(idx::VARCHAR, 4, '0') AS encounter_id, entity_id, idx, feature_id,
    CASE WHEN pos THEN 'positive' ELSE 'negative' END AS polarity FROM ps WHERE pos OR noise)"""

CASES = _rel(0.3) + """,
cs AS (SELECT DISTINCT case_id, 'symptom::' || trim(regexp_replace(lower(f), '[^a-z0-9]+', '_', 'g'), '_') AS feature_id FROM (
    SELECT query_id AS case_id, feature AS f FROM (SELECT l_suppkey AS query_id, p_name AS feature,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 3
    UNION ALL SELECT -n_nationkey - 1, n_name FROM nation)),
sc AS (SELECT case_id, entity_id, sum(weight) AS score, count(*) AS m FROM cs JOIN rel USING (feature_id) GROUP BY ALL)"""

CENTROIDS = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL),
q AS (SELECT label AS query_id, list(m / l ORDER BY pos) AS v FROM m JOIN (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label) USING (label) GROUP BY label)"""


def _search(distance: str, n: int, limit: float) -> str:
    return f"""WITH {CENTROIDS}, d AS (SELECT query_id, label::VARCHAR AS collection, vec_id AS chunk_id, {distance} AS d FROM q, embeddings),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(d, 9), chunk_id) AS r FROM d)
        SELECT query_id, collection, chunk_id, round(d + 1e-9, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), collection, chunk_id) AS rank
        FROM p WHERE r <= {n} AND d <= {limit} + 1e-9 QUALIFY rank <= {n}"""


L2 = "list_sum(list_transform(list_zip(v, embedding), lambda z: (z[1] - z[2]::DOUBLE) * (z[1] - z[2]::DOUBLE)))"
COS = "1 - list_sum(list_transform(list_zip(v, embedding), lambda z: z[1] * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))"

RETRIEVE = r"""docs AS (SELECT doc_id, lang, source, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents),
dtf AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM docs WHERE term <> '' GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(DISTINCT doc_id) FROM dtf) + 1) / (count(*) + 1)) AS idf FROM dtf GROUP BY term),
dx AS (SELECT doc_id, lang, source, term, tf * idf AS x FROM dtf JOIN idf USING (term) WHERE tf * idf > 0),
dv AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM dx),
qt AS (SELECT item_id, unnest(regexp_split_to_array(array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '),
    lambda w: coalesce(map {""" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ABBREVIATIONS.items()) + r"""}[regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')], w)), ' '),
    '[^\p{L}\p{N}]+')) AS term FROM benchmark),
qx AS (SELECT item_id, term, count(*) * any_value(idf) AS x FROM qt JOIN idf USING (term) WHERE term <> '' AND idf > 0 GROUP BY ALL),
qv AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM qx),
dot AS (SELECT item_id AS query_id, doc_id AS chunk_id, lang AS collection, source, greatest(0, 2 - 2 * sum(dv.w * qv.w)) AS d FROM dv JOIN qv USING (term) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(d, 9), chunk_id) AS r FROM dot WHERE d <= 1 + 1e-9)"""

CLASSIFIER = f"""WITH seg AS (SELECT c_custkey AS case_id, c_mktsegment AS label FROM customer),
hs AS (SELECT case_id, {_h('42', 'case_id')} AS h FROM seg),
cut AS (SELECT case_id, row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.7 + 1e-9) AS train FROM hs),
bag AS (SELECT DISTINCT o_custkey AS case_id, p_name AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
data AS (SELECT * FROM bag JOIN seg USING (case_id) JOIN cut USING (case_id)),
pairs AS (SELECT label, f, count(*) AS c FROM data WHERE train GROUP BY ALL),
lab AS (SELECT label, count(DISTINCT case_id) AS cases, count(*) AS total FROM data WHERE train GROUP BY label),
sums AS (SELECT sum(cases) AS n, count(*) AS l, (SELECT count(DISTINCT f) FROM pairs) AS w FROM lab),
test AS (SELECT case_id, label, f FROM data WHERE NOT train),
score AS (SELECT t.case_id, t.label, lab.label AS prediction, any_value(ln((cases + 1) / (n + l)))
      + coalesce(sum(ln((coalesce(c, 0) + 1) / (total + w))) FILTER (t.f IN (SELECT f FROM pairs)), 0) AS s
    FROM test t CROSS JOIN lab CROSS JOIN sums LEFT JOIN pairs ON pairs.label = lab.label AND pairs.f = t.f GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 9) DESC, prediction) AS r FROM score),
one AS (SELECT label AS t, prediction AS p FROM rk WHERE r = 1),
f1 AS (SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS t, count(*) FILTER (p = c) AS p
    FROM one, (SELECT t AS c FROM one UNION SELECT p FROM one) GROUP BY c),
best AS (SELECT case_id, min(r) FILTER (label = prediction) AS r FROM rk WHERE r <= 5 GROUP BY case_id)
SELECT sum(t)::BIGINT AS n, round(sum(tp) / sum(t) + 1e-9, 6) AS accuracy, round(avg(2 * tp / (t + p)) + 1e-9, 6) AS f1_macro,
  round(sum(2 * tp / (t + p) * t) / sum(t) + 1e-9, 6) AS f1_weighted,
  (SELECT round(avg((coalesce(r, 9) <= 1)::INT) + 1e-9, 6) FROM best) AS top1_accuracy,
  (SELECT round(avg((coalesce(r, 9) <= 3)::INT) + 1e-9, 6) FROM best) AS top3_accuracy,
  (SELECT round(avg((coalesce(r, 9) <= 5)::INT) + 1e-9, 6) FROM best) AS top5_accuracy FROM f1"""

PRIOR = f"""WITH {ENC},
cs AS (SELECT DISTINCT encounter_id AS case_id, entity_id AS label, feature_id FROM enc WHERE polarity = 'positive'),
sc AS (SELECT case_id, label, rel.entity_id, sum(weight) AS score FROM cs JOIN rel USING (feature_id) GROUP BY ALL),
z AS (SELECT case_id, sum(exp(score)) + (SELECT count(DISTINCT entity_id) FROM rel) - count(*) AS z FROM sc GROUP BY case_id),
rk AS (SELECT case_id, label, entity_id, row_number() OVER (PARTITION BY case_id ORDER BY round(exp(score) / z, 12) DESC, entity_id) AS r
    FROM sc JOIN z USING (case_id) QUALIFY r <= 5),
best AS (SELECT case_id, min(r) FILTER (label = entity_id) AS r FROM rk GROUP BY case_id)
SELECT count(*) AS n, round(avg((coalesce(r, 9) <= 1)::INT) + 1e-9, 6) AS top1_accuracy, round(avg((coalesce(r, 9) <= 3)::INT) + 1e-9, 6) AS top3_accuracy,
  round(avg((coalesce(r, 9) <= 5)::INT) + 1e-9, 6) AS top5_accuracy FROM best"""

QUERIES = {
    "split_exact": (split_exact, f"""WITH h AS (SELECT doc_id, {_h('42', 'doc_id')} AS h FROM documents)
        SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h) <= floor(count(*) OVER () * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS part FROM h"""),
    "split_stratified": (split_stratified, f"""WITH h AS (SELECT doc_id, lang, {_h('42', 'doc_id')} AS h FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r, count(*) OVER (PARTITION BY lang) AS n FROM h)
        SELECT lang, doc_id, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.85 + 1e-9) THEN 'val' ELSE 'test' END AS part FROM r"""),
    "split_leading": (split_leading, """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS part
        FROM documents"""),
    "encounters": (encounters, f"WITH {ENC} SELECT * FROM enc"),
    "encounters_simple": (encounters_simple, f"WITH {SIMPLE} SELECT * FROM simple"),
    "encounters_nested": (encounters_nested, f"""WITH {ENC} SELECT encounter_id, entity_id,
        coalesce(string_agg(feature_id, ',' ORDER BY feature_id) FILTER (polarity = 'positive'), '') AS positive,
        coalesce(string_agg(feature_id, ',' ORDER BY feature_id) FILTER (polarity = 'negative'), '') AS negative FROM enc GROUP BY ALL"""),
    "vocab_index": (vocab_index, r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS feature_id FROM documents)
        SELECT feature_id, row_number() OVER (ORDER BY feature_id) AS idx FROM w WHERE feature_id <> ''"""),
    "label_index": (label_index, f"WITH {_rel(0.4)} SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS idx FROM (SELECT DISTINCT entity_id FROM rel)"),
    "padded_ids": (padded_ids, f"""WITH {SIMPLE}, v AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) AS i FROM (SELECT DISTINCT feature_id FROM simple WHERE polarity = 'positive')),
        l AS (SELECT encounter_id, list(coalesce(i, 0) ORDER BY polarity = 'negative', feature_id) AS ids FROM simple LEFT JOIN v USING (feature_id) GROUP BY ALL)
        SELECT encounter_id, array_to_string(list_resize(ids, (SELECT max(len(ids)) FROM l), 0), ',') AS ids FROM l"""),
    "bag_rows": (bag_rows, f"""WITH {SIMPLE}, v AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) AS idx FROM (SELECT DISTINCT feature_id FROM rel))
        SELECT encounter_id, v.idx AS idx, 1.0::DOUBLE AS value FROM simple JOIN v USING (feature_id) WHERE polarity = 'positive'"""),
    "graph_prior_scores": (graph_prior_scores, f"WITH {CASES} SELECT case_id, entity_id, round(score + 1e-9, 4) AS score, m AS matched_features FROM sc"),
    "predict_topk": (predict_topk, f"""WITH {CASES}, lab AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) AS i FROM (SELECT DISTINCT entity_id FROM rel)),
        n AS (SELECT count(*) AS n FROM lab), sz AS (SELECT case_id, count(k.feature_id) AS matched, count(*) AS total FROM cs
          LEFT JOIN (SELECT DISTINCT feature_id FROM rel) k USING (feature_id) GROUP BY case_id),
        z AS (SELECT case_id, sum(exp(score)) + (SELECT n FROM n) - count(*) AS z FROM sc GROUP BY case_id),
        pr AS (SELECT case_id, entity_id, exp(score) / z AS p FROM sc JOIN z USING (case_id)),
        rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(p, 12) DESC, entity_id) AS rank FROM pr)
        SELECT case_id, entity_id, round(p + 1e-9, 6) AS probability, rank, matched AS matched_symptoms, total AS total_symptoms, NULL::VARCHAR AS warning
        FROM rk JOIN sz USING (case_id) WHERE rank <= 5
        UNION ALL SELECT case_id, entity_id, round(1.0 / n.n + 1e-9, 6), i, matched, total, 'no known feature' FROM sz, n, lab WHERE matched = 0 AND i <= 5"""),
    "classifier_metrics": (classifier_metrics, CLASSIFIER),
    "prior_metrics": (prior_metrics, PRIOR),
    "random_walks": (random_walks, None),
    "node_embeddings": (node_embeddings, None),
    "vector_topk": (vector_topk, _search(L2, 5, 2)),
    "vector_topk_cosine": (vector_topk_cosine, _search(COS, 10, 0.8)),
    "vector_topk_blocks": (vector_topk_blocks, _search(L2, 5, 2)),
    "retrieve_dense": (retrieve_dense, _search(L2, 5, 2).replace("FROM q, embeddings", "FROM q, embeddings JOIN documents ON doc_id = vec_id").replace(
        "SELECT query_id, collection, chunk_id, round(d + 1e-9, 6) AS distance,",
        "SELECT query_id, collection, chunk_id, round(1 - d + 1e-9, 6) AS relevance_score, (SELECT source FROM documents WHERE doc_id = chunk_id) AS source_file,")),
    "retrieve_documents": (retrieve_documents, f"""WITH {RETRIEVE} SELECT query_id, chunk_id, collection, round(1 - d + 1e-9, 6) AS relevance_score, source AS source_file,
        row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), collection, chunk_id) AS rank FROM p WHERE r <= 5 QUALIFY rank <= 5"""),
    "retrieve_filtered": (retrieve_filtered, "WITH " + RETRIEVE.replace("WHERE d <= 1 + 1e-9", """WHERE d <= 1 + 1e-9
          AND (query_id % 2 <> 0 OR collection IN ('en', 'de')) AND (query_id % 3 <> 0 OR source = 'src' || (query_id % 20))""") + """
        SELECT query_id, chunk_id, collection, round(1 - d + 1e-9, 6) AS relevance_score, source AS source_file,
          row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), collection, chunk_id) AS rank FROM p WHERE r <= 5 QUALIFY rank <= 5"""),
    "earlier_turns": (earlier_turns, """SELECT a.conv_id, a.turn, count(*) AS n, string_agg(m.role || ': ' || coalesce(m.text, ''), chr(10) ORDER BY m.turn) AS earlier
        FROM conversations a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) m ON m.conv_id = a.conv_id AND m.turn < a.turn
        WHERE a.role = 'user' AND m.i > (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn) - 3 GROUP BY ALL"""),
    "retrieve_context": (retrieve_context, None),
    "answer_batch": (answer_batch, None),
}
