"""Registered queries on events and conversations: monitoring, fusion, safety, context, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.operators import conversation as cv
from evigraph.operators import corpus as cp
from evigraph.operators import fusion as fu
from evigraph.operators import memo as mm
from evigraph.operators import monitoring as mo
from evigraph.operators import safety as sf
from evigraph.plans.tables import rnd, rounded, table
from evigraph.streaming import metrics as sm

SOURCE_OF = {"click": "neural", "view": "symbolic", "purchase": "rag", "signup": "context", "error": "neuro_symbolic"}


def performance(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("component"), F.lit("handle").alias("operation"), F.col("value").alias("duration"),
        (F.col("event_type") != "error").alias("success"))


def accuracy(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    flags = F.filter(F.array(F.when(F.col("event_type") == "error", F.lit("low_confidence")), F.when(v > 50, F.lit("high_uncertainty"))),
                     lambda x: x.isNotNull())
    return table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("query_type"), F.col("user_id").alias("entities_found"),
        (20 / (20 + v)).alias("confidence"), (v / (20 + v)).alias("uncertainty"), flags.alias("safety_flags"))


def errors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        "ts", F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("component"),
        F.when(F.col("value") > 20, "slow").otherwise("fast").alias("error_type"), F.col("props").alias("error_message"))


def evidence(spark, sf_dir) -> DataFrame:
    """Users as queries, event types as sources, the property number as the entity scored."""
    source = F.create_map(*[F.lit(x) for kv in SOURCE_OF.items() for x in kv])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), source.alias("source_type"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity"), (F.col("value") / (F.col("value") + 20)).alias("p"))
    scored = rows.groupBy("query_id", "source_type", "entity").agg(F.max("p").alias("p"))
    per = scored.groupBy("query_id", "source_type").agg(F.avg("p").alias("confidence"))
    seq = F.array_position(F.array(*[F.lit(s) for s in SOURCE_OF.values()]), F.col("source_type")) - 1
    return scored.join(per, ["query_id", "source_type"]).select(
        "query_id", seq.cast("int").alias("seq"), "source_type", "entity", "p", "confidence", (0.5 * (1 - F.col("confidence"))).alias("uncertainty"))


def feedback(spark, sf_dir) -> DataFrame:
    source = F.create_map(*[F.lit(x) for kv in SOURCE_OF.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        source.alias("source_type"), F.dayofyear("ts").alias("batch"), (F.col("value") / (F.col("value") + 20)).alias("p"), (k >= 50).alias("truth"))


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def user_turns(spark, sf_dir) -> DataFrame:
    return cv.number_turns(messages(spark, sf_dir).where(F.col("role") == "user"))


def turn_entities(spark, sf_dir) -> DataFrame:
    """Distinct words of a user turn as its entities."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3))
    rows = user_turns(spark, sf_dir).select("conv_id", "turn_no", F.explode(words).alias("entity"))
    n = F.char_length("entity")
    return rows.select("conv_id", "turn_no", "entity", F.least(F.lit(0.95), n / 20).alias("confidence"),
                       F.when(n > 8, "SYMPTOM").otherwise("DISEASE").alias("entity_type"))


def responses(spark, sf_dir) -> DataFrame:
    m = messages(spark, sf_dir).where(F.col("role") == "assistant")
    c = F.least(F.lit(1.0), F.char_length("text") / 1200)
    rows = m.select("conv_id", "turn", F.col("text").alias("response"), c.alias("confidence"), (1 - c).alias("uncertainty"),
                    F.array(F.struct(F.element_at(F.split(F.lower("text"), " "), 1).alias("concept_name"), F.lit("DISEASE").alias("concept_type"))).alias("entities"))
    apart = sf.contradictions(rows.select(F.col("conv_id").alias("query_id"), "confidence"), 0.1).withColumnRenamed("query_id", "conv_id")
    return rows.join(apart, "conv_id", "left")


PERF_COLS = ["success_rate", "error_rate", "avg_response_time", "min_response_time", "max_response_time", "p95_response_time",
             "p99_response_time", "median_response_time"]


def perf_summary(spark, sf_dir):
    return rounded(mo.performance_summary(performance(spark, sf_dir)), *PERF_COLS)


def perf_by_component(spark, sf_dir):
    return rounded(mo.performance_summary(performance(spark, sf_dir), ["component"]), *PERF_COLS)


def accuracy_summary(spark, sf_dir):
    return rounded(mo.accuracy_summary(accuracy(spark, sf_dir)), "avg_confidence", "avg_uncertainty", "avg_entities_per_query")


def flag_distribution(spark, sf_dir):
    return mo.flag_distribution(accuracy(spark, sf_dir))


def error_summary(spark, sf_dir):
    return mo.error_summary(errors(spark, sf_dir))


def recent_errors(spark, sf_dir):
    return mo.recent_errors(errors(spark, sf_dir)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "component", "error_type")


def component_health(spark, sf_dir):
    return rounded(mo.component_health(performance(spark, sf_dir)), "error_rate", "avg_response_time")


def component_statistics(spark, sf_dir):
    return rounded(mo.component_statistics(performance(spark, sf_dir)), "total_duration", "avg_response_time", "error_rate", places=4)


def latency_histogram(spark, sf_dir):
    return mo.histogram(performance(spark, sf_dir), "duration", mo.RESPONSE_EDGES)


def confidence_histogram(spark, sf_dir):
    return mo.histogram(accuracy(spark, sf_dir), "confidence", mo.CONFIDENCE_EDGES)


def system_status(spark, sf_dir):
    df = mo.system_overview(performance(spark, sf_dir), accuracy(spark, sf_dir), errors(spark, sf_dir))
    return rounded(df, "success_rate_1h", "avg_response_time", "avg_confidence")


def hourly_trend(spark, sf_dir):
    return mo.hourly_trend(performance(spark, sf_dir)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


def dashboard(spark, sf_dir):
    return mo.dashboard(performance(spark, sf_dir), accuracy(spark, sf_dir), errors(spark, sf_dir))


def latency_benchmark(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("duration"))
    return rounded(mo.latency_summary(samples), "mean", "std", "min", "max", "median", "p95", "p99")


def throughput(spark, sf_dir):
    batches = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("batch_size"), F.col("value").alias("duration"))
    return rounded(mo.throughput(batches), "samples_per_second", "seconds_per_sample")


def alert_hits(spark, sf_dir):
    hits = mo.alert_candidates(mo.hourly_stats(performance(spark, sf_dir), accuracy(spark, sf_dir)))
    return hits.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "name", "severity")


def alerts(spark, sf_dir):
    fired = mo.alerts(performance(spark, sf_dir), accuracy(spark, sf_dir))
    return fired.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "name", "severity", "message")


def sliding_metrics(spark, sf_dir):
    rows = rounded(sm.sliding_performance(performance(spark, sf_dir)), *PERF_COLS)
    return rows.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts", "window_start")


def source_weights(spark, sf_dir):
    src = fu.sources(evidence(spark, sf_dir), fu.default_reliability(spark))
    return rounded(src.select("query_id", "source_type", "weight", "predictions"), "weight")


def fuse_weighted(spark, sf_dir):
    return rounded(fu.fuse(evidence(spark, sf_dir), fu.default_reliability(spark)), "confidence", "uncertainty")


def fuse_bayes(spark, sf_dir):
    return rounded(fu.fuse(evidence(spark, sf_dir), fu.default_reliability(spark), "bayesian"), "confidence", "uncertainty")


def overall_confidence(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    src = fu.sources(ev, fu.default_reliability(spark))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    return rounded(fu.overall(fu.fuse_weighted(ev, src), src, customers), "overall_confidence", "overall_uncertainty", "calibration_quality")


def reasoning_chain(spark, sf_dir):
    return fu.reasoning_chain(fu.sources(evidence(spark, sf_dir), fu.default_reliability(spark)))


def feedback_confusion(spark, sf_dir):
    return rounded(fu.feedback_confusion(feedback(spark, sf_dir)), "accuracy", "precision", "recall")


def reliability_ema(spark, sf_dir):
    df = fu.update_reliability(fu.default_reliability(spark), feedback(spark, sf_dir))
    return rounded(df, "accuracy", "precision", "recall")


def contradictions(spark, sf_dir):
    rows = evidence(spark, sf_dir).select("query_id", F.col("p").alias("confidence"))
    return sf.contradictions(rows, 0.08)


def safety_flags(spark, sf_dir):
    a = sf.assess(responses(spark, sf_dir))
    return a.select("conv_id", "turn", F.array_join(F.array_sort("flags"), ",").alias("flags"), F.size("blocked_content").alias("blocked"),
                    F.size("warnings").alias("warnings"), F.size("disclaimers").alias("disclaimers"), F.size("recommendations").alias("recommendations"))


def safety_risk(spark, sf_dir):
    a = sf.assess(responses(spark, sf_dir))
    return a.select("conv_id", "turn", "risk_level", "human_review_required", rnd("confidence_override").alias("confidence_override"))


def safety_sanitized(spark, sf_dir):
    return sf.sanitize(sf.assess(responses(spark, sf_dir))).select("conv_id", "turn", "sanitized")


def response_parse(spark, sf_dir):
    m = messages(spark, sf_dir).where(F.col("role") == "assistant")
    return m.select("conv_id", "turn", tx.parsed_response(F.col("text")).alias("r")).select(
        "conv_id", "turn", rnd("r.confidence").alias("confidence"), F.col("r.word_count").alias("word_count"),
        F.col("r.has_disclaimers").alias("has_disclaimers"), F.size("r.reasoning_chain").alias("steps"))


def conversation_latest(spark, sf_dir):
    return cv.latest(messages(spark, sf_dir))


def conversation_context(spark, sf_dir):
    return cv.last_messages(messages(spark, sf_dir), 5).select("conv_id", "turn", "role", "rank")


def conversation_turns(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", "turn_no")


def entity_timeline(spark, sf_dir):
    t = cv.entity_timeline(turn_entities(spark, sf_dir))
    return t.select("conv_id", "entity", "mentions", "first_mention", "last_mention",
                    F.array_join(F.transform("confidence_trend", lambda x: F.format_string("%.2f", x)), ",").alias("trend"))


def entity_mentions(spark, sf_dir):
    return cv.entity_mentions(turn_entities(spark, sf_dir))


def topic_tracking(spark, sf_dir):
    return cv.topic_turns(user_turns(spark, sf_dir), turn_entities(spark, sf_dir))


def relevant_turns(spark, sf_dir):
    return rounded(cv.relevant_turns(turn_entities(spark, sf_dir)), "relevance")


def context_summary(spark, sf_dir):
    turns, ents = user_turns(spark, sf_dir), turn_entities(spark, sf_dir)
    out = cv.context_summary(turns, ents, cv.topic_turns(turns, ents))
    return out.select("conv_id", "turns", F.array_join("recent_entities", ",").alias("recent_entities"), F.array_join("topics", ",").alias("topics"))


def query_expand(spark, sf_dir):
    return messages(spark, sf_dir).where(F.col("role") == "user").select("conv_id", "turn", tx.expand_query(F.col("text")).alias("expanded"))


def sft_rows(spark, sf_dir):
    return cp.instruction_rows(messages(spark, sf_dir)).select("conv_id", "input", "output")


def cache_keys(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", tx.result_key(F.col("role"), F.col("text")).alias("key"))


def _reuse(spark, sf_dir):
    """Stored results of the assistant's messages serve the messages of everybody."""
    m = messages(spark, sf_dir)
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    stored = mm.keyed(m.where(F.col("role") == "assistant").select(F.col("text").alias("input")), "length").groupBy("key_hash").agg(F.min("input").alias("input"))
    store = stored.select(F.lit("length").alias("component"), "key_hash", "input", F.char_length("input").cast("string").alias("result"),
                           (at - F.expr("INTERVAL 10 MINUTES")).alias("stored_at"), F.lit(0).cast("bigint").alias("hits"))
    compute = lambda missing: missing.withColumn("result", F.char_length("input").cast("string"))
    return mm.reuse(m.select("conv_id", "turn", F.col("text").alias("input")), store, "length", compute, at, max_bytes=2)


def memo_reuse(spark, sf_dir):
    answered, _ = _reuse(spark, sf_dir)
    return answered.select("conv_id", "turn", "result", "hit")


def memo_store(spark, sf_dir):
    _, store = _reuse(spark, sf_dir)
    return store.select("component", "key_hash", "result", "hits")


def memo_statistics(spark, sf_dir):
    answered, _ = _reuse(spark, sf_dir)
    return rounded(mm.reuse_statistics(answered), "hit_rate")


# --- SQL counterparts -------------------------------------------------------------------------

PERF = "perf AS (SELECT ts, event_type AS component, value AS d, event_type <> 'error' AS ok FROM events)"
ACC = "acc AS (SELECT ts, event_type, user_id, value, 20 / (20 + value) AS c, value / (20 + value) AS u FROM events)"
ERR = "err AS (SELECT ts, 'svc' || user_id AS component, CASE WHEN value > 20 THEN 'slow' ELSE 'fast' END AS error_type FROM events WHERE event_type = 'error')"


def _r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr} + 1e-9, {places}) AS {name}"


ALERT_TESTS = {"high_error_rate": "er > 0.1", "slow_response_time": "d > 5", "low_confidence_predictions": "c < 0.5", "high_uncertainty": "u > 0.8"}
# every event in the twelve trailing hours that hold it, named by their end
PERF_WINDOWS = """perf AS (SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE * k, '%Y-%m-%d %H:%M:%S') AS at,
    event_type AS component, value AS d, event_type <> 'error' AS ok FROM events, (SELECT unnest(range(1, 13)) AS k))"""


def _perf_sql(by: str, source: str = PERF) -> str:
    group = f"{by}," if by else ""
    return f"""WITH {source}, s AS (SELECT {group} list(d ORDER BY d) AS l, count(*) AS total_requests, avg(ok::INT) AS sr, avg((NOT ok)::INT) AS er,
        avg(d) AS a, min(d) AS lo, max(d) AS hi FROM perf {'GROUP BY ' + by if by else ''})
        SELECT {group} total_requests, {_r('sr', 'success_rate')}, {_r('er', 'error_rate')}, {_r('a', 'avg_response_time')},
        {_r('lo', 'min_response_time')}, {_r('hi', 'max_response_time')},
        {_r('l[least(floor(0.95 * total_requests)::INT, total_requests - 1) + 1]', 'p95_response_time')},
        {_r('l[least(floor(0.99 * total_requests)::INT, total_requests - 1) + 1]', 'p99_response_time')},
        {_r('(l[(total_requests - 1) // 2 + 1] + l[total_requests // 2 + 1]) / 2', 'median_response_time')} FROM s"""


def _hist_sql(value: str, edges, labels, source: str, name: str) -> str:
    rows = []
    for i, label in enumerate(labels):
        low = f"{value} >= {edges[i - 1]}" if i else "true"
        high = f"{value} < {edges[i]}" if i < len(edges) else "true"
        rows.append(f"SELECT {i} AS bucket_no, '{label}' AS bucket, count(*) FILTER ({low} AND {high}) AS n FROM {name}")
    return f"WITH {source} " + " UNION ALL ".join(rows)


SRC_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_OF.items()) + " END"
REL = "rel(source_type, acc, prec, rec, cal) AS (VALUES " + ", ".join(
    f"('{n}', {a}::DOUBLE, {p}::DOUBLE, {r}::DOUBLE, {c}::DOUBLE)" for n, a, p, r, c in fu.RELIABILITY) + ")"
EVIDENCE = f"""{REL}, ev0 AS (SELECT user_id AS query_id, {SRC_CASE} AS source_type, 'k' || (props->>'$.k') AS entity,
    max(value / (value + 20)) AS p FROM events GROUP BY ALL),
src0 AS (SELECT query_id, source_type, avg(p) AS c, 0.5 * (1 - avg(p)) AS u, count(*) AS predictions FROM ev0 GROUP BY ALL),
src1 AS (SELECT s.*, cal, greatest(0.1, CASE source_type WHEN 'neural' THEN 0.4 WHEN 'symbolic' THEN 0.3 WHEN 'rag' THEN 0.2 WHEN 'context' THEN 0.1
    ELSE 0.25 END * c * greatest(0.1, 1 - u) * (0.4 * coalesce(acc, 0.7) + 0.6 * coalesce(cal, 0.7))) AS raw FROM src0 s LEFT JOIN rel USING (source_type)),
src AS (SELECT *, raw / sum(raw) OVER (PARTITION BY query_id) AS w FROM src1),
ew AS (SELECT query_id, source_type, entity, p, c, u, w, cal FROM ev0 JOIN src USING (query_id, source_type))"""
FUSED = EVIDENCE + """,
f0 AS (SELECT query_id, entity, sum(w * p) / sum(w) AS c, sum(w * u) / sum(w) AS u, avg(coalesce(cal, 1)) AS k, count(*) AS source_count FROM ew GROUP BY ALL),
fused AS (SELECT query_id, entity, least(1, greatest(0, c * k + (1 - k) * 0.5)) AS c, u, source_count FROM f0)"""

FEEDBACK = f"""fb AS (SELECT {SRC_CASE} AS source_type, dayofyear(ts) AS batch, value / (value + 20) > 0.5 AS said, (props->>'$.k')::INT >= 50 AS truth FROM events),
conf AS (SELECT source_type, batch, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp,
    count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM fb GROUP BY ALL),
m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS a, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM conf)"""

TURNS = """turns AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations WHERE role = 'user')"""
ENTS = TURNS + r""",
ents AS (SELECT conv_id, turn_no, entity, least(0.95, length(entity) / 20) AS c, CASE WHEN length(entity) > 8 THEN 'SYMPTOM' ELSE 'DISEASE' END AS entity_type
    FROM (SELECT DISTINCT conv_id, turn_no, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS entity FROM turns) WHERE length(entity) >= 3)"""
TOPICS = ENTS + """,
tops AS (SELECT conv_id, turn_no, lower(entity_type) AS topic FROM ents UNION
    SELECT conv_id, turn_no, unnest(list_filter([""" + ", ".join(
    f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in tx.TOPIC_KEYWORDS.items()) + """], lambda x: x IS NOT NULL)) FROM turns)"""

RESP = """resp0 AS (SELECT conv_id, turn, text, lower(string_split(lower(text), ' ')[1]) AS ent, least(1, length(text) / 1200) AS c FROM conversations WHERE role = 'assistant'),
apart AS (SELECT conv_id, count(*) > 1 AND var_pop(c) > 0.1 AS contra FROM resp0 GROUP BY conv_id),
resp AS (SELECT *, 1 - c AS u, c < 0.7 AS lowc, 1 - c > 0.5 AS highu FROM resp0 JOIN apart USING (conv_id))"""

KEY = "'medical:length:' || substr(sha256(lower(trim(text, ' ' || chr(10) || chr(9) || chr(13)))), 1, 16)"
MEMO = f"""req AS (SELECT conv_id, turn, role, text, {KEY} AS k FROM conversations),
st AS (SELECT k, length(min(text))::VARCHAR AS result FROM req WHERE role = 'assistant' GROUP BY k)"""

NOTED = "contains(lower(text), 'consult') OR contains(lower(text), 'healthcare professional')"


def _terms(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(l, '{t}')::INT" for t in terms) + ")"


QUERIES = {
    "perf_summary": (perf_summary, _perf_sql("")),
    "perf_by_component": (perf_by_component, _perf_sql("component")),
    "accuracy_summary": (accuracy_summary, f"""WITH {ACC} SELECT count(*) AS total_queries, {_r('avg(c)', 'avg_confidence')}, {_r('avg(u)', 'avg_uncertainty')},
        {_r('avg(user_id)', 'avg_entities_per_query')}, count(*) FILTER (c > 0.8) AS high_confidence_queries,
        count(*) FILTER (c < 0.5) AS low_confidence_queries, count(*) FILTER (u > 0.7) AS high_uncertainty_queries FROM acc"""),
    "flag_distribution": (flag_distribution, """SELECT 'low_confidence' AS flag, count(*) AS times FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'high_uncertainty', count(*) FROM events WHERE value > 50"""),
    "error_summary": (error_summary, f"""WITH {ERR} SELECT 'total' AS kind, 'all' AS key, count(*) AS errors FROM err
        UNION ALL SELECT 'component', component, count(*) FROM err GROUP BY ALL UNION ALL SELECT 'type', error_type, count(*) FROM err GROUP BY ALL"""),
    "recent_errors": (recent_errors, f"""WITH {ERR} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, component, error_type FROM err
        ORDER BY ts DESC, component, error_type LIMIT 10"""),
    "component_health": (component_health, f"""WITH {PERF}, s AS (SELECT component, avg((NOT ok)::INT) AS er, avg(d) AS a, count(*) AS n FROM perf GROUP BY ALL)
        SELECT component, CASE WHEN er < 0.01 THEN 'healthy' WHEN er < 0.05 THEN 'degraded' ELSE 'unhealthy' END AS status,
        {_r('er', 'error_rate')}, {_r('a', 'avg_response_time')}, n AS total_requests FROM s"""),
    "component_statistics": (component_statistics, f"""WITH {PERF} SELECT component, count(*) AS total_requests, {_r('sum(d)', 'total_duration', 4)},
        count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count, {_r('avg(d)', 'avg_response_time', 4)},
        {_r('avg((NOT ok)::INT)', 'error_rate', 4)} FROM perf GROUP BY component"""),
    "latency_histogram": (latency_histogram, _hist_sql("d", *mo.RESPONSE_EDGES, PERF, "perf")),
    "confidence_histogram": (confidence_histogram, _hist_sql("c", *mo.CONFIDENCE_EDGES, ACC, "acc")),
    "system_status": (system_status, f"""WITH {PERF}, {ACC}, {ERR}, e AS (SELECT max(ts) AS t FROM events),
        p AS (SELECT count(*) FILTER (ts >= t - INTERVAL 1 HOUR) AS requests_1h, count(*) FILTER (ts >= t - INTERVAL 24 HOUR) AS requests_24h,
          avg(ok::INT) FILTER (ts >= t - INTERVAL 1 HOUR) AS sr, avg(d) FILTER (ts >= t - INTERVAL 1 HOUR) AS a FROM perf, e),
        c AS (SELECT avg(c) AS c FROM acc, e WHERE ts >= t - INTERVAL 1 HOUR), x AS (SELECT count(*) AS n FROM err, e WHERE ts >= t - INTERVAL 1 HOUR)
        SELECT requests_1h, requests_24h, {_r('sr', 'success_rate_1h')}, {_r('a', 'avg_response_time')}, {_r('c', 'avg_confidence')}, n AS total_errors_1h,
          CASE WHEN sr IS NULL THEN 'unknown' WHEN 1 - sr > 0.1 OR c < 0.4 OR n > 50 THEN 'unhealthy' WHEN 1 - sr > 0.05 OR c < 0.6 OR n > 20 THEN 'degraded'
          ELSE 'healthy' END AS system_status FROM p, c, x"""),
    "hourly_trend": (hourly_trend, f"""WITH {PERF} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS requests,
        count(*) FILTER (NOT ok) AS errors FROM perf GROUP BY 1"""),
    "dashboard": (dashboard, None),
    "latency_benchmark": (latency_benchmark, f"""WITH s AS (SELECT value FROM events ORDER BY event_id OFFSET 10)
        SELECT count(*) AS samples, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, {_r('min(value)', 'min')}, {_r('max(value)', 'max')},
        {_r('median(value)', 'median')}, {_r('quantile_cont(value, 0.95)', 'p95')}, {_r('quantile_cont(value, 0.99)', 'p99')} FROM s"""),
    "throughput": (throughput, f"""SELECT {_r('sum(user_id + 1) / sum(value)', 'samples_per_second')}, {_r('sum(value) / sum(user_id + 1)', 'seconds_per_sample')} FROM events"""),
    "alert_hits": (alert_hits, f"""WITH {PERF}, {ACC}, h AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS t, avg((NOT ok)::INT) AS er, avg(d) AS d FROM perf GROUP BY 1),
        a AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS t, avg(c) AS c, avg(u) AS u FROM acc GROUP BY 1), j AS (SELECT * FROM h FULL JOIN a USING (t))
        SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS at, name, severity FROM (SELECT t, 'high_error_rate' AS name, 'warning' AS severity FROM j WHERE er > 0.1
          UNION ALL SELECT t, 'slow_response_time', 'warning' FROM j WHERE d > 5 UNION ALL SELECT t, 'low_confidence_predictions', 'warning' FROM j WHERE c < 0.5
          UNION ALL SELECT t, 'high_uncertainty', 'critical' FROM j WHERE u > 0.8)"""),
    "alerts": (alerts, f"""WITH RECURSIVE {PERF}, {ACC}, k AS (SELECT unnest(range(1, 6)) AS k),
        h AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * k AS t, avg((NOT ok)::INT) AS er, avg(d) AS d FROM perf, k GROUP BY 1),
        a AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE * k AS t, avg(c) AS c, avg(u) AS u FROM acc, k GROUP BY 1), j AS (SELECT * FROM h FULL JOIN a USING (t)),
        hit AS ({' UNION ALL '.join(f"SELECT t, '{n}' AS name, '{s}' AS severity, '{m}' AS message FROM j WHERE {ALERT_TESTS[n]}" for n, _, s, m in mo.ALERT_RULES)}),
        nxt AS (SELECT a.*, b.t AS later FROM hit a ASOF LEFT JOIN hit b ON a.name = b.name AND a.t + INTERVAL {mo.REFIRE_SECONDS} SECOND < b.t),
        fired AS (SELECT * FROM nxt WHERE (name, t) IN (SELECT (name, min(t)) FROM hit GROUP BY name)
          UNION ALL SELECT nxt.* FROM fired JOIN nxt ON nxt.name = fired.name AND nxt.t = fired.later)
        SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS at, name, severity, message FROM fired"""),
    "sliding_metrics": (sliding_metrics, _perf_sql('component, "at"', PERF_WINDOWS)),
    "source_weights": (source_weights, f"WITH {EVIDENCE} SELECT query_id, source_type, {_r('w', 'weight')}, predictions FROM src"),
    "fuse_weighted": (fuse_weighted, f"WITH {FUSED} SELECT query_id, entity, {_r('c', 'confidence')}, {_r('u', 'uncertainty')}, source_count FROM fused"),
    "fuse_bayes": (fuse_bayes, f"""WITH {EVIDENCE}, b AS (SELECT query_id, entity, product(least(1 - 1e-12, greatest(1e-12, p))) AS pp,
          product(1 - least(1 - 1e-12, greatest(1e-12, p))) AS pq, avg(u * w) AS u, count(*) AS source_count FROM ew GROUP BY ALL)
        SELECT query_id, entity, {_r('pp / (pp + pq)', 'confidence')}, {_r('u', 'uncertainty')}, source_count FROM b"""),
    "overall_confidence": (overall_confidence, f"""WITH {FUSED}, f AS (SELECT query_id, avg(c) AS pc, avg(u) AS pu FROM fused GROUP BY ALL),
        s AS (SELECT query_id, avg(c) AS sc, avg(u) AS su, count(*) AS n, avg(coalesce(cal, 0.5) * c) AS q FROM src GROUP BY ALL)
        SELECT c_custkey AS query_id, {_r('coalesce(least(1, greatest(0, 0.7 * pc + 0.3 * sc + least(0.1, n * 0.02))), 0)', 'overall_confidence')},
          {_r('CASE WHEN n IS NULL THEN 1 ELSE least(1, greatest(0, (0.6 * pu + 0.4 * su) * CASE WHEN n > 1 THEN 1 / sqrt(n) ELSE 1 END)) END', 'overall_uncertainty')},
          coalesce(n, 0) AS n_sources, {_r('coalesce(q, 0)', 'calibration_quality')}
        FROM customer LEFT JOIN f ON f.query_id = c_custkey LEFT JOIN s ON s.query_id = c_custkey"""),
    "reasoning_chain": (reasoning_chain, None),
    "feedback_confusion": (feedback_confusion, f"""WITH {FEEDBACK} SELECT source_type, batch, tp, fp, fn, tn, {_r('a', 'accuracy')}, {_r('p', 'precision')},
        {_r('r', 'recall')} FROM m"""),
    "reliability_ema": (reliability_ema, f"""WITH {REL}, {FEEDBACK}, l AS (SELECT source_type, count(*) AS n, list(a ORDER BY batch) AS a, list(p ORDER BY batch) AS p,
          list(r ORDER BY batch) AS r FROM m GROUP BY ALL), j AS (SELECT source_type, n, list_prepend(coalesce(acc, 0.5), a) AS a, list_prepend(coalesce(prec, 0.5), p) AS p,
          list_prepend(coalesce(rec, 0.5), r) AS r, coalesce(cal, 0.5) AS cal FROM l FULL JOIN rel USING (source_type))
        SELECT source_type, {_r('list_reduce(a, lambda x, y: 0.9 * x + 0.1 * y)', 'accuracy')}, {_r('list_reduce(p, lambda x, y: 0.9 * x + 0.1 * y)', 'precision')},
          {_r('list_reduce(r, lambda x, y: 0.9 * x + 0.1 * y)', 'recall')}, cal AS calibration, coalesce(n, 0) AS batches FROM j"""),
    "contradictions": (contradictions, f"WITH {EVIDENCE} SELECT query_id, count(*) > 1 AND var_pop(p) > 0.08 AS contradictory FROM ev0 GROUP BY query_id"),
    "safety_flags": (safety_flags, f"""WITH {RESP} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contra THEN 'contradictory_evidence' END,
          CASE WHEN highu THEN 'high_uncertainty' END, CASE WHEN lowc THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS flags, 0 AS blocked,
          contra::INT + highu::INT + lowc::INT AS warnings, 2 + highu::INT AS disclaimers, (lowc OR highu)::INT + contra::INT AS recommendations FROM resp"""),
    "safety_risk": (safety_risk, f"""WITH {RESP} SELECT conv_id, turn, CASE WHEN c < 0.5 OR u > 0.7 OR contra OR lowc OR highu THEN 'moderate' ELSE 'low' END AS risk_level,
          contra AS human_review_required, round(CASE WHEN highu OR contra OR lowc THEN greatest(0, c - (highu::INT * 0.2 + contra::INT * 0.3 + lowc::INT * 0.1)) END + 1e-9, 6)
          AS confidence_override FROM resp"""),
    "safety_sanitized": (safety_sanitized, f"""WITH {RESP} SELECT conv_id, turn, array_to_string(list_filter([
          array_to_string(list_transform(list_filter([CASE WHEN lowc THEN '{sf.WARNINGS['low_confidence']}' END,
            CASE WHEN highu THEN '{sf.WARNINGS['high_uncertainty']}' END, CASE WHEN contra THEN '{sf.WARNINGS['contradictory_evidence']}' END],
            lambda x: x IS NOT NULL), lambda x: 'WARNING: ' || x), chr(10)), text,
          array_to_string(list_transform(list_filter(['{sf.GENERAL_DISCLAIMER}', '{sf.ENTITY_DISCLAIMER}',
            CASE WHEN highu THEN '{sf.DISCLAIMERS['high_uncertainty']}' END], lambda x: x IS NOT NULL), lambda x: 'DISCLAIMER: ' || x), chr(10)),
          array_to_string(list_transform(list_filter([CASE WHEN lowc OR highu THEN 'Arrange an appointment for a proper evaluation.' END,
            CASE WHEN contra THEN 'Consider a second opinion.' END], lambda x: x IS NOT NULL), lambda x: 'RECOMMENDATION: ' || x), chr(10))],
          lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS sanitized FROM resp"""),
    "response_parse": (response_parse, f"""WITH r AS (SELECT conv_id, turn, text, lower(text) AS l, {NOTED} AS noted FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, {_r(f"least(0.9, greatest(0.1, 0.6 + 0.1 * {_terms(tx.SURE_TERMS)} - 0.1 * {_terms(tx.UNSURE_TERMS)} - 0.05 * {_terms(tx.HEDGE_TERMS)} + 0.05 * noted::INT))", 'confidence')},
          len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + CASE WHEN noted THEN 0 ELSE {len(tx.NOTICE.split())} END AS word_count,
          contains(l, 'disclaimer') OR contains(l, 'consult') AS has_disclaimers, 0 AS steps FROM r"""),
    "conversation_latest": (conversation_latest, """SELECT conv_id, substr(max_by(text, turn), 1, 30) AS latest, count(*) AS messages, max(turn) AS last_turn
        FROM conversations GROUP BY conv_id"""),
    "conversation_context": (conversation_context, """SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank
        FROM conversations) WHERE rank <= 5"""),
    "conversation_turns": (conversation_turns, f"WITH {TURNS} SELECT conv_id, turn, turn_no FROM turns"),
    "entity_timeline": (entity_timeline, f"""WITH {ENTS} SELECT conv_id, entity, count(*) AS mentions, min(turn_no) AS first_mention, max(turn_no) AS last_mention,
        array_to_string(list_transform(list(c ORDER BY turn_no)[-3:], lambda x: printf('%.2f', x)), ',') AS trend FROM ents GROUP BY conv_id, entity"""),
    "entity_mentions": (entity_mentions, f"WITH {ENTS} SELECT entity, count(*) AS mentions, max(turn_no) AS last_mention FROM ents GROUP BY entity"),
    "topic_tracking": (topic_tracking, f"""WITH {TOPICS} SELECT conv_id, topic, count(*) AS turns, min(turn_no) AS first_turn, max(turn_no) AS last_turn
        FROM tops GROUP BY ALL"""),
    "relevant_turns": (relevant_turns, f"""WITH {ENTS}, n AS (SELECT conv_id, turn_no, count(*) AS n FROM ents GROUP BY ALL),
        o AS (SELECT a.conv_id, a.turn_no, b.turn_no AS past_turn, count(*) AS overlap FROM ents a JOIN ents b ON a.conv_id = b.conv_id AND a.entity = b.entity
          AND b.turn_no BETWEEN a.turn_no - 3 AND a.turn_no - 1 GROUP BY ALL)
        SELECT conv_id, turn_no, past_turn, overlap, round(overlap / n + 1e-9, 6) AS relevance, row_number() OVER (PARTITION BY conv_id, turn_no
          ORDER BY overlap / n DESC, past_turn) AS rank FROM o JOIN n USING (conv_id, turn_no) QUALIFY rank <= 3"""),
    "context_summary": (context_summary, f"""WITH {TOPICS}, t AS (SELECT conv_id, count(*) AS n, max(turn_no) AS l FROM turns GROUP BY ALL),
        e AS (SELECT conv_id, list(DISTINCT entity ORDER BY entity)[1:5] AS es FROM ents JOIN t USING (conv_id) WHERE turn_no > l - 3 GROUP BY ALL),
        p AS (SELECT conv_id, list(DISTINCT topic ORDER BY topic) AS ts FROM tops GROUP BY ALL)
        SELECT conv_id, least(n, 10) AS turns, coalesce(array_to_string(es, ','), '') AS recent_entities, coalesce(array_to_string(ts, ','), '') AS topics
        FROM t LEFT JOIN e USING (conv_id) LEFT JOIN p USING (conv_id)"""),
    "query_expand": (query_expand, r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '),
        lambda w: coalesce(map {""" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ABBREVIATIONS.items()) + r"""}[regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g')], w)), ' ') AS expanded
        FROM conversations WHERE role = 'user'"""),
    "sft_rows": (sft_rows, """SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS input,
        coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS output FROM conversations GROUP BY conv_id"""),
    "cache_keys": (cache_keys, """SELECT conv_id, turn, 'medical:' || role || ':' || substr(sha256(lower(trim(text, ' ' || chr(10) || chr(9) || chr(13)))), 1, 16) AS key
        FROM conversations"""),
    "memo_reuse": (memo_reuse, f"""WITH {MEMO} SELECT conv_id, turn, coalesce(st.result, length(min(text) OVER (PARTITION BY k))::VARCHAR) AS result,
        st.k IS NOT NULL AS hit FROM req LEFT JOIN st USING (k)"""),
    "memo_store": (memo_store, f"""WITH {MEMO}, u AS (SELECT k, count(*) AS n, length(min(text))::VARCHAR AS result FROM req GROUP BY k)
        SELECT 'length' AS component, k AS key_hash, coalesce(st.result, u.result) AS result, CASE WHEN st.k IS NULL THEN 0 ELSE n END AS hits
        FROM u LEFT JOIN st USING (k) WHERE st.k IS NOT NULL OR length(u.result) <= 2"""),
    "memo_statistics": (memo_statistics, f"""WITH {MEMO} SELECT count(st.k) AS hits, count(*) - count(st.k) AS misses, count(*) AS total_requests,
        round(count(st.k) / count(*) + 1e-9, 6) AS hit_rate FROM req LEFT JOIN st USING (k)"""),
}
