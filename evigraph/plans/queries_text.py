"""Registered queries on documents: corpus, chunks, collections, dictionary, linking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import similarity, text as tx
from evigraph.operators import chunking as ck
from evigraph.operators import corpus as cp
from evigraph.operators import dictionary as dc
from evigraph.operators import documents as dm
from evigraph.operators import evaluate as ev
from evigraph.operators import linking as ln
from evigraph.plans.tables import rnd, rounded, table
from evigraph.session import cut_lineage


def combined_documents(spark, sf_dir) -> DataFrame:
    return cp.combine_records(table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source"), "doc_id", "lang")


def corpus_of(spark, sf_dir) -> DataFrame:
    return cp.annotation_corpus(combined_documents(spark, sf_dir), "documents")


def benchmark_names(spark, sf_dir) -> DataFrame:
    """A dictionary from the benchmark passages: words as symptoms, word pairs as diseases."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    base = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    single = base.select(F.explode("w").alias("name")).where(F.char_length("name") >= 3).select(
        F.lit("SYMPTOM").alias("concept_type"), "name")
    pairs = base.where(F.size("w") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2),
                              lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("name")
    ).where(F.char_length("name") >= 3).select(F.lit("DISEASE").alias("concept_type"), "name")
    return single.unionByName(pairs).distinct().select(
        F.concat(F.lower(F.substring("concept_type", 1, 1)), F.lit(":"), "name").alias("concept_id"), "name",
        tx.display_name(F.col("name")).alias("display_name"), "concept_type", F.lit(0).cast("bigint").alias("load_seq"),
    )


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def corpus_combine(spark, sf_dir):
    return combined_documents(spark, sf_dir)


def corpus_clean(spark, sf_dir):
    return corpus_of(spark, sf_dir)


def corpus_stats(spark, sf_dir):
    return rounded(cp.corpus_statistics(corpus_of(spark, sf_dir)), "avg_length", "median_length")


def corpus_splits(spark, sf_dir):
    return cp.split_counts(corpus_of(spark, sf_dir))


def doc_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_document_text(F.col("text")).alias("cleaned"))


def doc_metadata(spark, sf_dir):
    return dm.document_metadata(documents(spark, sf_dir)).select("doc_id", "document_type", "patient_id", F.col("date").cast("string").alias("date"))


def doc_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return dm.document_text(pages)


def chunk_windows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ck.chunk_rows(docs, ck.window_chunks(F.col("text")), "doc_id").drop("metadata")


def chunk_sections(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ck.chunk_rows(docs, ck.section_chunks(F.col("text")), "doc_id").drop("metadata")


def chunk_paragraphs(spark, sf_dir):
    # lines stand in for paragraphs: the given texts have no blank lines
    docs = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return ck.chunk_rows(docs, ck.paragraph_chunks(F.col("text")), "doc_id").drop("metadata")


def chunk_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ck.chunk_rows(docs, ck.document_chunks(F.col("text")), "doc_id").drop("metadata")


def stored_chunks(spark, sf_dir) -> DataFrame:
    docs = dm.document_metadata(table(spark, sf_dir, "documents")).withColumn(
        "_m", dm.string_metadata({"document_type": F.col("document_type"), "lang": F.col("lang"),
                                  "source_file": F.col("source"), "patient_id": F.col("patient_id"), "date": F.col("date")})
    )
    return dm.collection_rows(ck.chunk_rows(docs, ck.document_chunks(F.col("text")), "doc_id", "_m"))


def route_collections(spark, sf_dir):
    return stored_chunks(spark, sf_dir).select(
        "id", "collection", F.element_at("metadata", "chunk_index").alias("chunk_index"),
        F.element_at("metadata", "start_char").alias("start_char"), F.element_at("metadata", "source_file").alias("source_file"),
        F.size("metadata").alias("keys"),
    )


def collection_counts(spark, sf_dir):
    return dm.collection_counts(stored_chunks(spark, sf_dir))


def dictionary_containment(spark, sf_dir):
    return dc.find_names(documents(spark, sf_dir), benchmark_names(spark, sf_dir)).select("doc_id", "label", "name", "start", "end")


def dictionary_extract(spark, sf_dir):
    return dc.extract_entities(documents(spark, sf_dir), benchmark_names(spark, sf_dir)).select(
        "doc_id", "label", "name", "mention", "start", "end", "confidence")


def dictionary_extract_words(spark, sf_dir):
    found = dc.find_names(documents(spark, sf_dir), benchmark_names(spark, sf_dir), word_bounded=True)
    return found.select("doc_id", "label", "name", "start", "end")


def aliases(spark, sf_dir):
    return dc.alias_table(_part_names(spark, sf_dir)).select("concept_type", "alias", "concept_id")


def _part_names(spark, sf_dir) -> DataFrame:
    """Parts as diseases (brand and type as name), colours and shapes of their names as symptoms."""
    parts = table(spark, sf_dir, "part")
    d = parts.select(F.concat(F.lit("d:"), F.col("p_partkey").cast("string")).alias("concept_id"),
                     F.lower(F.concat_ws(" ", "p_brand", "p_type", F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")))).alias("name"),
                     F.lit("DISEASE").alias("concept_type"), F.col("p_partkey").alias("load_seq"))
    s = parts.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("load_seq")).select(
        F.concat(F.lit("s:"), "name").alias("concept_id"), "name", F.lit("SYMPTOM").alias("concept_type"), "load_seq")
    return d.unionByName(s).withColumn("display_name", F.initcap("name"))


def candidates_exact_alias(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    mentions = table(spark, sf_dir, "part").select(
        F.explode(F.split(F.concat_ws(",", "p_name", "p_brand", "p_type", F.lower("p_name")), "[, ]")).alias("mention"))
    mentions = mentions.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("mention")))
    out = ln.generate_candidates(mentions, names, 10, stages=("exact", "alias"))
    return out.select("mention", "rank", "concept_type", "concept_id", "name", "score", "stage", "candidates_considered")


def _typos(spark, sf_dir) -> DataFrame:
    """Dictionary names with one letter dropped and two swapped, as users mistype them."""
    n = benchmark_names(spark, sf_dir).select("name").distinct()
    typo = F.concat(F.substring("name", 1, 3), F.substr("name", F.lit(6), F.lit(1)), F.substr("name", F.lit(5), F.lit(1)),
                    F.substr("name", F.lit(7)))
    return n.select(typo.alias("mention"))


def candidates_fuzzy(spark, sf_dir):
    pairs = ln.fuzzy_pairs(_typos(spark, sf_dir), benchmark_names(spark, sf_dir))
    return rounded(pairs, "ratio")


def candidates_partial(spark, sf_dir):
    pairs = ln.containment_pairs(_typos(spark, sf_dir).unionByName(
        benchmark_names(spark, sf_dir).select(F.col("name").alias("mention"))), benchmark_names(spark, sf_dir))
    return rounded(pairs, "ratio")


def candidates_all(spark, sf_dir):
    return rounded(ln.generate_candidates(_typos(spark, sf_dir), benchmark_names(spark, sf_dir)).drop("display_name"), "score")


def link_documents(spark, sf_dir):
    return rounded(ln.link_documents(documents(spark, sf_dir), benchmark_names(spark, sf_dir)), "confidence_score")


def _evaluation(spark, sf_dir) -> DataFrame:
    """Word-bounded annotation as truth, plain substring extraction as prediction."""
    docs, names = documents(spark, sf_dir), benchmark_names(spark, sf_dir)
    to_spans = lambda s: s.select(
        F.col("doc_id").cast("string").alias("id"), (F.col("start") * 2 + (F.col("label") == "SYMPTOM").cast("int")).alias("seq"),
        F.col("mention").alias("text"), F.col("label").alias("type"), "start", "end")
    pred = to_spans(dc.extract_entities(docs, names))
    truth = to_spans(dc.extract_entities(docs, names, word_bounded=True))
    return ev.match_spans(pred, truth)


def span_match_eval(spark, sf_dir):
    return rounded(ev.document_metrics(_evaluation(spark, sf_dir)), "precision", "recall", "f1_score", "accuracy")


def type_metrics(spark, sf_dir):
    df = ev.corpus_type_metrics(ev.type_metrics(_evaluation(spark, sf_dir)))
    return rounded(df, "precision", "recall", "f1_score")


def evaluation_report(spark, sf_dir):
    return rounded(ev.evaluation_report(cut_lineage(_evaluation(spark, sf_dir))), "value")


def annotation_stats(spark, sf_dir):
    names = benchmark_names(spark, sf_dir)
    annotated = cut_lineage(dc.annotate(documents(spark, sf_dir), names))
    words = names.where(F.col("concept_type") == "DISEASE").select(F.col("name").alias("entity"), F.explode(F.split("name", " ")).alias("feature"))
    edges = words.join(names.where(F.col("concept_type") == "SYMPTOM").select(F.col("name").alias("feature")), "feature", "left_semi")
    return rounded(cp.annotation_statistics(annotated, edges, names), "diseases_per_text", "symptoms_per_text", "pairs_per_text")


def bio_tokens(spark, sf_dir):
    annotated = dc.annotate(documents(spark, sf_dir), benchmark_names(spark, sf_dir))
    count = lambda test: F.size(F.filter("labelled", test)).cast("bigint")
    return cp.label_arrays(annotated).where(F.size("labelled") > 0).select(
        "id", F.size("labelled").cast("bigint").alias("tokens"), count(lambda t: t["label"].startswith("B-")).alias("begins"),
        count(lambda t: t["label"].startswith("I-")).alias("insides"), F.array_max("labelled.end").alias("last_end"),
    )


def bio_decode(spark, sf_dir):
    annotated = dc.annotate(documents(spark, sf_dir), benchmark_names(spark, sf_dir))
    labelled = cp.label_arrays(annotated).withColumn("labelled", F.transform("labelled", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label"), F.lit(0.9).alias("confidence"))))
    return cp.decode_arrays(labelled).drop("confidence")


def ranking_rows(spark, sf_dir):
    annotated = dc.annotate(documents(spark, sf_dir), benchmark_names(spark, sf_dir))
    rows = cp.ranking_rows(annotated)
    return rows.select("id", "mention_text", "concept_type", "left_context", "right_context", "string_similarity", "label")


def string_features(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    f = similarity.string_features(F.col("p_name"), F.lower("p_type"))
    return parts.select("p_partkey", f.alias("f")).select(
        "p_partkey", rnd("f.ratio").alias("ratio"), rnd("f.length_ratio").alias("length_ratio"), F.col("f.exact").alias("exact"))


def classification_metrics(spark, sf_dir):
    df = ev.classification_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(df, "accuracy", "f1_macro", "f1_weighted")


# --- SQL counterparts -------------------------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

COMBINED = f"""record AS (SELECT doc_id, lang, trim(concat_ws(' ', nullif(text, ''), nullif(source, '')), {WS}) AS fields FROM documents),
combined AS (SELECT lang || '_' || doc_id AS id, lang AS split, fields AS combined_text, length(fields) AS text_length FROM record WHERE fields <> '')"""

CORPUS = COMBINED + r""",
cleaned AS (SELECT id, split, text_length AS original_length, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(combined_text, '\s+', ' ', 'g')), '[\x00-\x1f\x7f-\x{9f}]', '', 'g'), '[.]{3,}', '...', 'g'),
    '-{2,}', '--', 'g'), '([.!?])\s*([A-Z])', '\1 \2', 'g')) AS text FROM combined WHERE text_length BETWEEN 50 AND 5000),
corpus AS (SELECT *, length(text) AS cleaned_length, 'documents' AS source FROM cleaned WHERE length(text) >= 50)"""

METADATA = r"""meta AS (SELECT doc_id, text, CASE
    WHEN lower(text) SIMILAR TO '(?s).*(clinical note|progress note|consultation|discharge summary|hospital discharge).*' THEN 'clinical_notes'
    WHEN lower(text) SIMILAR TO '(?s).*(pathology report|lab report|laboratory).*' THEN 'patient_records'
    WHEN lower(text) SIMILAR TO '(?s).*(disease information|medical condition|diagnosis guide).*' THEN 'disease_info'
    ELSE 'clinical_notes' END AS document_type,
    coalesce(nullif(regexp_extract(text, '(?i)patient\s+id\s*:?\s*([\p{L}\p{N}_]+)', 1), ''),
             nullif(regexp_extract(text, '(?i)mrn\s*:?\s*([\p{L}\p{N}_]+)', 1), ''),
             nullif(regexp_extract(text, '(?i)medical\s+record\s+number\s*:?\s*([\p{L}\p{N}_]+)', 1), ''),
             nullif(regexp_extract(text, '(?i)patient\s+number\s*:?\s*([\p{L}\p{N}_]+)', 1), '')) AS patient_id,
    regexp_extract(text, '(?i)date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1) AS d1,
    regexp_extract(text, '(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})', 1) AS d2 FROM documents),
dated AS (SELECT doc_id, document_type, patient_id, CAST(coalesce(try_strptime(d1, ['%m/%d/%Y', '%m-%d-%Y', '%m/%d/%y', '%m-%d-%y']),
    try_strptime(d2, ['%m/%d/%Y', '%m-%d-%Y', '%m/%d/%y', '%m-%d-%y']))::DATE AS VARCHAR) AS date FROM meta)"""

WINDOWS = r"""sized AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 800)::INT + 1 END AS n
    FROM documents),
raw_windows AS (SELECT doc_id, i, substr(text, i * 800 + 1, 1000) AS text, i * 800 AS s, least(i * 800 + 1000, length(sized.text)) AS e
    FROM sized, range(n) t(i)),
windows AS (SELECT doc_id, text, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
    FROM raw_windows WHERE trim(text, """ + WS + r""") <> '')"""

# no header lines and no blank lines in the given texts: one chunk, or windows of the (stripped, when long) text
DOC_CHUNKS = f"""based AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN trim(text, {WS}) ELSE text END AS t,
    CASE WHEN length(text) > 2000 THEN length(text) - length(ltrim(text, {WS})) ELSE 0 END AS off FROM documents),
counted AS (SELECT *, CASE WHEN length(t) <= 1000 THEN 1 ELSE ceil((length(t) - 1000) / 800)::INT + 1 END AS n FROM based),
cut AS (SELECT doc_id, i, length(t) > 1000 AS many, substr(t, i * 800 + 1, 1000) AS text, off + i * 800 AS s, off + least(i * 800 + 1000, length(t)) AS e
    FROM counted, range(n) r(i)),
dc AS (SELECT doc_id, CASE WHEN many THEN '_window_' ELSE '_chunk_' END AS kind, text, s, e,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM cut WHERE NOT many OR trim(text, {WS}) <> '')"""

# lines are paragraphs; every one is a state of the fold, so that the first starts it
PARAGRAPHS = f"""pl AS (SELECT doc_id, i, line, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 2 AS ahead
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
pp AS (SELECT doc_id, i, trim(line, {WS}) AS t, (ahead + length(line) - length(ltrim(line, {WS})))::INT AS s FROM pl WHERE trim(line, {WS}) <> ''),
pf AS (SELECT doc_id, list_reduce(list({{'cur': t, 's': s, 'e': (s + length(t))::INT, 'out': []::STRUCT(t VARCHAR, s INT, e INT)[]}} ORDER BY i),
    lambda a, b: CASE WHEN length(a.cur) + length(b.cur) > 1000
      THEN {{'cur': right(a.cur, 200) || chr(10) || chr(10) || b.cur, 's': b.s, 'e': b.e, 'out': a.out || [{{'t': trim(a.cur, {WS}), 's': a.s, 'e': a.e}}]}}
      ELSE {{'cur': a.cur || chr(10) || chr(10) || b.cur, 's': a.s, 'e': b.e, 'out': a.out}} END) AS f FROM pp GROUP BY doc_id),
pc AS (SELECT doc_id, f.out || [{{'t': trim(f.cur, {WS}), 's': f.s, 'e': f.e}}] AS l FROM pf),
semantic AS (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS k FROM pc)"""

NAMES = r"""bw AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
names AS (SELECT DISTINCT concept_type, name, lower(concept_type[1]) || ':' || name AS concept_id FROM (
    SELECT 'SYMPTOM' AS concept_type, unnest(w) AS name FROM bw
    UNION ALL SELECT 'DISEASE', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM bw)
    WHERE length(name) >= 3)"""

FOUND = NAMES + """,
found AS (SELECT doc_id, concept_type AS label, name, concept_id, instr(lower(text), name) - 1 AS s,
    instr(lower(text), name) - 1 + length(name) AS e, substr(text, instr(lower(text), name), length(name)) AS mention
    FROM documents, names WHERE contains(lower(text), name))"""

KEPT = FOUND + """,
sorted AS (SELECT doc_id, list({'label': label, 'name': name, 'mention': mention, 's': s, 'e': e} ORDER BY s, e DESC, label) AS l
    FROM found GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: {'k': [x], 'e': x.e}),
    lambda a, b: CASE WHEN b.k[1].s >= a.e THEN {'k': a.k || b.k, 'e': b.e} ELSE a END).k) AS k FROM sorted)"""

# tokens with their places, each with the last annotation over it: symptoms after diseases, later positions last
LABELLED = KEPT + r""",
pieces AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS n FROM (
    SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]') AS l FROM documents)),
placed AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM pieces),
tokens AS (SELECT doc_id, n, e - length(token) AS s, e FROM placed WHERE regexp_matches(token, '\S')),
hits AS (SELECT doc_id, k.label AS label, k.s AS ks, k.e AS ke FROM kept),
labelled AS (SELECT t.doc_id, n, t.s, t.e, label, t.s <= ks AS first FROM tokens t
    LEFT JOIN hits h ON t.doc_id = h.doc_id AND h.ks < t.e AND h.ke > t.s
    QUALIFY row_number() OVER (PARTITION BY t.doc_id, n ORDER BY label = 'SYMPTOM' DESC, ks DESC) = 1)"""

BOUNDED = FOUND + r""",
bounded AS (SELECT doc_id, chr(1) || regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_ ]', chr(1), 'g') || chr(1) AS t FROM documents),
b AS (SELECT doc_id, label, name, least(nullif(instr(t, ' ' || name || ' '), 0), nullif(instr(t, ' ' || name || chr(1)), 0),
        nullif(instr(t, chr(1) || name || ' '), 0), nullif(instr(t, chr(1) || name || chr(1)), 0)) - 1 AS s
      FROM (SELECT DISTINCT doc_id, label, name FROM found) JOIN bounded USING (doc_id))"""

# both extractions without overlaps, predictions taken in order, each with the free truth of largest overlap
MATCHED = BOUNDED + """,
spans AS (SELECT doc_id, 'p' AS side, label, mention AS text, s, e FROM found
    UNION ALL SELECT doc_id, 't', label, substr(text, s + 1, length(name)), s, s + length(name) FROM b JOIN documents USING (doc_id) WHERE s IS NOT NULL),
ordered AS (SELECT doc_id, side, list({'type': label, 'text': text, 's': s, 'e': e} ORDER BY s, e DESC, label) AS l FROM spans GROUP BY ALL),
alone AS (SELECT doc_id, side, list_reduce(list_transform(l, lambda x: {'k': [x], 'e': x.e}),
    lambda a, b: CASE WHEN b.k[1].s >= a.e THEN {'k': a.k || b.k, 'e': b.e} ELSE a END).k AS l FROM ordered),
sides AS (SELECT doc_id, coalesce(any_value(l) FILTER (side = 'p'), []) AS p, coalesce(any_value(l) FILTER (side = 't'), []) AS t
    FROM alone GROUP BY doc_id),
folded AS (SELECT doc_id, p, t, list_reduce(
    [{'a': t[0], 'out': []::STRUCT(o DOUBLE, j BIGINT)[]}] || list_transform(p, lambda a: {'a': a, 'out': []::STRUCT(o DOUBLE, j BIGINT)[]}),
    lambda st, x: {'a': x.a, 'out': st.out || [list_sort(list_transform(
        list_filter(range(1, len(t) + 1), lambda j: least(x.a.e, t[j].e) > greatest(x.a.s, t[j].s) AND NOT list_contains(list_transform(st.out, lambda u: u.j), j)),
        lambda j: {'o': -(least(x.a.e, t[j].e) - greatest(x.a.s, t[j].s)) / greatest(x.a.e - x.a.s, t[j].e - t[j].s), 'j': j}))[1]]}).out AS out
    FROM sides),
m AS (SELECT doc_id, p[i] AS pred, t[out[i].j] AS truth, -out[i].o AS o FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM folded)
    UNION ALL SELECT doc_id, NULL, t[j], 0 FROM (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM folded) WHERE NOT list_contains(list_transform(out, lambda u: u.j), j)),
matches AS (SELECT *, CASE WHEN truth IS NULL THEN 'no_match' WHEN pred IS NULL THEN 'missing' WHEN o < 0.8 THEN 'partial'
    WHEN pred.type = truth.type THEN 'exact' ELSE 'type_mismatch' END AS kind FROM m)"""

METRICS = """count(*) FILTER (kind = 'exact') AS exact_matches, count(*) FILTER (kind = 'partial') AS partial_matches,
    count(*) FILTER (kind = 'type_mismatch') AS type_mismatches, count(*) FILTER (kind = 'no_match') AS false_positives,
    count(*) FILTER (kind = 'missing') AS false_negatives, count(pred) AS total_predictions, count(truth) AS total_ground_truth"""

RATES = """coalesce(exact_matches / nullif(total_predictions, 0), 0) AS precision, coalesce(exact_matches / nullif(total_ground_truth, 0), 0) AS recall,
    coalesce(2 * exact_matches / nullif(total_predictions + total_ground_truth, 0), 0) AS f1_score,
    coalesce(exact_matches / nullif(greatest(total_predictions, total_ground_truth), 0), 0) AS accuracy"""

# per document and type, then means weighted by support
TYPED = """marks AS (
    SELECT doc_id, pred.type AS type, 1 AS tp, 0 AS fp, 0 AS fn FROM matches WHERE kind = 'exact'
    UNION ALL SELECT doc_id, pred.type, 0, 1, 0 FROM matches WHERE kind IN ('no_match', 'type_mismatch')
    UNION ALL SELECT doc_id, truth.type, 0, 0, 1 FROM matches WHERE kind IN ('missing', 'type_mismatch')),
per AS (SELECT doc_id, type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM marks GROUP BY ALL),
typed AS (SELECT type, sum(tp + fn)::BIGINT AS support,
    coalesce(sum(coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn)) / nullif(sum(tp + fn), 0), 0) AS precision,
    coalesce(sum(coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn)) / nullif(sum(tp + fn), 0), 0) AS recall,
    coalesce(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)) / nullif(sum(tp + fn), 0), 0) AS f1_score
    FROM per GROUP BY type)"""

PART_NAMES = """d AS (SELECT 'd:' || p_partkey AS concept_id, lower(p_brand || ' ' || p_type || ' (' || p_size || ')') AS name,
    'DISEASE' AS concept_type, p_partkey AS load_seq FROM part),
s AS (SELECT 's:' || lower(p_name) AS concept_id, lower(p_name) AS name, 'SYMPTOM' AS concept_type, min(p_partkey) AS load_seq
    FROM part GROUP BY ALL),
kb AS (SELECT * FROM d UNION ALL SELECT * FROM s),
parts AS (SELECT *, trim(regexp_replace(name, '\\b(syndrome|disease|disorder|condition|symptom)\\b', '', 'g')) AS cleaned,
    string_split(name, ' ') AS ws, trim(regexp_replace(name, '\\([^)]*\\)', '', 'g')) AS bare FROM kb),
written AS (SELECT concept_type, concept_id, load_seq, unnest([name, CASE WHEN cleaned NOT IN ('', name) THEN cleaned END,
    CASE WHEN len(ws) >= 2 THEN ws[1] END, CASE WHEN len(ws) >= 2 THEN ws[-1] END,
    CASE WHEN bare NOT IN ('', name) THEN bare END]) AS alias, unnest([1, 2, 3, 4, 5]) AS pos FROM parts),
alias AS (SELECT concept_type, alias, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY concept_type, alias
    ORDER BY load_seq DESC, pos DESC, concept_id) AS r FROM written WHERE alias IS NOT NULL) WHERE r = 1)"""

QUERIES = {
    "corpus_combine": (corpus_combine, f"WITH {COMBINED} SELECT * FROM combined"),
    "corpus_clean": (corpus_clean, f"WITH {CORPUS} SELECT * FROM corpus"),
    "corpus_stats": (corpus_stats, f"""WITH {CORPUS} SELECT count(*) AS total_texts, round(avg(cleaned_length) + 1e-9, 6) AS avg_length,
        round(median(cleaned_length) + 1e-9, 6) AS median_length, min(cleaned_length) AS min_length,
        max(cleaned_length) AS max_length FROM corpus"""),
    "corpus_splits": (corpus_splits, f"WITH {CORPUS} SELECT split, count(*) AS texts FROM corpus GROUP BY ALL"),
    "doc_clean": (doc_clean, r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'),
        '(?i)page \d+ of \d+', '', 'g'), '(?m)\d+\s*$', '', 'g'), '[^\p{L}\p{M}\p{N}_\s.,;:()/\-]', '', 'g')) AS cleaned FROM documents"""),
    "doc_metadata": (doc_metadata, f"WITH {METADATA} SELECT * FROM dated"),
    "doc_pages": (doc_pages, """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
        SELECT doc_id AS source_file, len(l) AS page_count,
          coalesce(array_to_string(list_transform(list_filter(l, lambda x: x <> ''), lambda x: x || chr(10) || chr(10)), ''), '') AS text FROM p"""),
    "chunk_windows": (chunk_windows, f"""WITH {WINDOWS} SELECT text, doc_id || '_window_' || k AS chunk_id, doc_id::VARCHAR AS document_id,
        k AS chunk_index, s AS start_char, e AS end_char FROM windows"""),
    "chunk_sections": (chunk_sections, """SELECT text, doc_id || '_chunk_0' AS chunk_id, doc_id::VARCHAR AS document_id, 0 AS chunk_index,
        0 AS start_char, length(text) AS end_char FROM documents"""),
    "chunk_paragraphs": (chunk_paragraphs, f"""WITH {PARAGRAPHS} SELECT c.t AS text, doc_id || '_semantic_' || k AS chunk_id,
        doc_id::VARCHAR AS document_id, k AS chunk_index, c.s AS start_char, c.e AS end_char FROM semantic"""),
    "chunk_documents": (chunk_documents, f"""WITH {DOC_CHUNKS} SELECT text, doc_id || kind || k AS chunk_id, doc_id::VARCHAR AS document_id,
        k AS chunk_index, s AS start_char, e AS end_char FROM dc"""),
    "route_collections": (route_collections, f"""WITH {DOC_CHUNKS}, {METADATA} SELECT dc.doc_id || kind || k AS id, document_type AS collection,
        k::VARCHAR AS chunk_index, s::VARCHAR AS start_char, source AS source_file,
        7 + (patient_id IS NOT NULL)::INT + (date IS NOT NULL)::INT AS keys
        FROM dc JOIN dated USING (doc_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"""),
    "collection_counts": (collection_counts, f"""WITH {DOC_CHUNKS}, {METADATA}, c AS (SELECT document_type AS collection, count(*) AS documents
        FROM dc JOIN dated USING (doc_id) GROUP BY ALL)
        SELECT * FROM c UNION ALL SELECT 'total', sum(documents)::BIGINT FROM c"""),
    "dictionary_containment": (dictionary_containment, f'WITH {FOUND} SELECT doc_id, label, name, s AS start, e AS "end" FROM found'),
    "dictionary_extract": (dictionary_extract, f"""WITH {KEPT} SELECT doc_id, k.label, k.name, k.mention, k.s AS start, k.e AS "end",
        0.8::DOUBLE AS confidence FROM kept"""),
    "dictionary_extract_words": (dictionary_extract_words, "WITH " + BOUNDED + """
        SELECT doc_id, label, name, s AS start, s + length(name) AS "end" FROM b WHERE s IS NOT NULL"""),
    "aliases": (aliases, f"WITH {PART_NAMES} SELECT * FROM alias"),
    "candidates_exact_alias": (candidates_exact_alias, f"""WITH {PART_NAMES},
        asked AS (SELECT DISTINCT lower(trim(m)) AS mention FROM (SELECT unnest(regexp_split_to_array(
            p_name || ',' || p_brand || ',' || p_type || ',' || lower(p_name), '[, ]')) AS m FROM part UNION ALL SELECT p_name FROM part)),
        names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_type, name ORDER BY load_seq DESC) AS r FROM kb) WHERE r = 1),
        firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_type, concept_id ORDER BY load_seq) AS r FROM kb) WHERE r = 1),
        hits AS (SELECT mention, n.concept_type, n.concept_id, n.name, 1.0::DOUBLE AS score, 'exact' AS stage FROM asked JOIN names n ON mention = n.name
          UNION ALL SELECT mention, a.concept_type, a.concept_id, f.name, 0.9::DOUBLE, 'alias' FROM asked JOIN alias a ON mention = a.alias
            JOIN firsts f ON f.concept_id = a.concept_id AND f.concept_type = a.concept_type
            WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.name = mention AND n.concept_type = a.concept_type))
        SELECT *, count(*) OVER (PARTITION BY mention) AS candidates_considered,
          row_number() OVER (PARTITION BY mention ORDER BY score DESC, concept_type, concept_id) AS rank FROM hits"""),
    "candidates_fuzzy": (candidates_fuzzy, None),
    "candidates_partial": (candidates_partial, f"""WITH {NAMES}, n AS (SELECT DISTINCT name FROM names),
        m AS (SELECT DISTINCT m FROM (SELECT name[1:3] || name[6:6] || name[5:5] || name[7:] AS m FROM n UNION ALL SELECT name FROM n))
        SELECT m AS mention, name, round(least(length(m), length(name)) / greatest(length(m), length(name)) + 1e-9, 6) AS ratio
        FROM m, n WHERE (contains(m, name) OR contains(name, m)) AND length(m) >= 3
          AND least(length(m), length(name)) / greatest(length(m), length(name)) >= 0.5"""),
    "candidates_all": (candidates_all, None),
    "link_documents": (link_documents, None),
    "span_match_eval": (span_match_eval, f"""WITH {MATCHED}, c AS (SELECT doc_id::VARCHAR AS id, {METRICS} FROM matches GROUP BY ALL),
        r AS (SELECT *, {RATES} FROM c)
        SELECT * REPLACE (round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall,
          round(f1_score + 1e-9, 6) AS f1_score, round(accuracy + 1e-9, 6) AS accuracy) FROM r"""),
    "type_metrics": (type_metrics, f"""WITH {MATCHED}, {TYPED} SELECT type, round(precision + 1e-9, 6) AS precision,
        round(recall + 1e-9, 6) AS recall, round(f1_score + 1e-9, 6) AS f1_score, support FROM typed"""),
    "evaluation_report": (evaluation_report, f"""WITH {MATCHED}, {TYPED}, c AS (SELECT {METRICS} FROM matches), r AS (SELECT *, {RATES} FROM c),
        wrong AS (SELECT CASE kind WHEN 'no_match' THEN 'false_positive' ELSE 'false_negative' END AS error,
          coalesce(pred.text, truth.text) AS text, count(*) AS times FROM matches WHERE kind IN ('no_match', 'missing') GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY error ORDER BY times DESC, text) <= 5),
        long AS (
          SELECT CASE WHEN metric IN ('exact_matches', 'partial_matches', 'type_mismatches', 'false_positives', 'false_negatives')
            THEN 'entity' ELSE 'overall' END AS section, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM r) ON COLUMNS(*) INTO NAME metric VALUE value)
          UNION ALL SELECT 'type', type || '.' || metric, value
            FROM (UNPIVOT (SELECT type, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1_score::DOUBLE AS f1_score, support::DOUBLE AS support FROM typed)
              ON precision, recall, f1_score, support INTO NAME metric VALUE value)
          UNION ALL SELECT 'common_' || error, text, times::DOUBLE FROM wrong)
        SELECT section, metric, round(value + 1e-9, 6) AS value FROM long"""),
    "annotation_stats": (annotation_stats, f"""WITH {KEPT}, per AS (SELECT count(*) FILTER (k.label = 'DISEASE') AS d,
          count(*) FILTER (k.label = 'SYMPTOM') AS s FROM kept), n AS (SELECT count(*) AS n FROM documents),
        ed AS (SELECT DISTINCT name AS entity, f FROM (SELECT name, unnest(string_split(name, ' ')) AS f FROM names WHERE concept_type = 'DISEASE')
               WHERE f IN (SELECT name FROM names WHERE concept_type = 'SYMPTOM')),
        ent AS (SELECT DISTINCT doc_id, k.mention AS m, k.label AS label FROM kept),
        pr AS (SELECT count(*) AS p FROM ent a JOIN ed ON a.m = ed.entity AND a.label = 'DISEASE'
               JOIN ent b ON b.doc_id = a.doc_id AND b.m = ed.f AND b.label = 'SYMPTOM')
        SELECT n AS annotated_texts, d AS diseases, s AS symptoms, p AS pairs, round(d / n + 1e-9, 6) AS diseases_per_text,
          round(s / n + 1e-9, 6) AS symptoms_per_text, round(p / n + 1e-9, 6) AS pairs_per_text,
          (SELECT count(*) FROM names WHERE concept_type = 'DISEASE') AS kb_diseases,
          (SELECT count(*) FROM names WHERE concept_type = 'SYMPTOM') AS kb_symptoms FROM per, n, pr"""),
    "bio_tokens": (bio_tokens, f"""WITH {LABELLED} SELECT doc_id::VARCHAR AS id, count(*) AS tokens, count(*) FILTER (label IS NOT NULL AND first) AS begins,
          count(*) FILTER (label IS NOT NULL AND NOT first) AS insides, max(e)::INT AS last_end FROM labelled GROUP BY doc_id"""),
    "bio_decode": (bio_decode, f"""WITH {LABELLED}, opened AS (SELECT *, sum((label IS NOT NULL AND first)::INT) OVER w AS o, sum((label IS NULL)::INT) OVER w AS c
          FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        seen AS (SELECT *, first_value(label) OVER w AS l0, first_value(c) OVER w AS c0 FROM opened WINDOW w AS (PARTITION BY doc_id, o ORDER BY n)),
        ends AS (SELECT doc_id, o, l0, min(s) AS s, max(e) AS e FROM seen WHERE o > 0 AND label = l0 AND c = c0 GROUP BY ALL)
        SELECT doc_id::VARCHAR AS id, s::INT AS start, e::INT AS "end", l0 AS label, substr(text, s::INT + 1, (e - s)::INT) AS text
        FROM ends JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"""),
    "ranking_rows": (ranking_rows, f"""WITH {KEPT}, dd AS (SELECT doc_id, text FROM documents)
        SELECT doc_id::VARCHAR AS id, k.mention AS mention_text, k.label AS concept_type,
          text[greatest(k.s - 49, 1):k.s] AS left_context, text[k.e + 1:k.e + 50] AS right_context, 1.0::DOUBLE AS string_similarity, 1 AS label
        FROM kept JOIN dd USING (doc_id)"""),
    "string_features": (string_features, None),
    "classification_metrics": (classification_metrics, """WITH c AS (SELECT unnest([0, 1]) AS c), f AS (SELECT c,
          count(*) FILTER (quality = c AND toxic = c) AS tp, count(*) FILTER (quality = c) AS t, count(*) FILTER (toxic = c) AS p
          FROM c, labels GROUP BY c), g AS (SELECT *, 2 * tp / (t + p) AS f1 FROM f)
        SELECT sum(t)::BIGINT AS n, round(sum(tp) / sum(t) + 1e-9, 6) AS accuracy, round(avg(f1) + 1e-9, 6) AS f1_macro,
          round(sum(f1 * t) / sum(t) + 1e-9, 6) AS f1_weighted FROM g"""),
}
