"""Streams give what the batch gives; readers and writers round-trip."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import conversation as cv
from evigraph.operators import fusion as fu
from evigraph.operators import monitoring as mo
from evigraph.operators import weights as wt
from evigraph.operators import graph as gr
from evigraph.sources import graph_store as gs
from evigraph.sources import readers as rd
from evigraph.sources import writers as wr
from evigraph.streaming import ingest as ing
from evigraph.streaming import metrics as sm
from evigraph.streaming import stateful as st


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(300).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("component"),
        F.lit("op").alias("operation"), (F.col("id") % 10 * 1.0).alias("duration"), (F.col("id") % 4 != 0).alias("success"),
        F.create_map().cast("map<string,string>").alias("metadata"))
    rows.repartition(3).write.mode("overwrite").parquet(folder)
    return folder


def test_sliding_equals_batch(spark, events):
    stream = run(sm.sliding_performance(sm.read_events(spark, events, "perf_events"), retention="10 minutes"), "sliding")
    batch = sm.sliding_performance(spark.read.parquet(events))
    cols = ["total_requests", "avg_response_time", "median_response_time", "p95_response_time", "p99_response_time"]
    got = {(r.ts, r.component): tuple(r[c] for c in cols) for r in stream.collect()}
    want = {(r.ts, r.component): tuple(r[c] for c in cols) for r in batch.collect()}
    assert got and all(want[k] == pytest.approx(v) for k, v in got.items())
    end, component = sorted(want)[20]
    inside = spark.read.parquet(events).where((F.col("ts") < F.lit(end)) & (F.col("ts") >= F.lit(end) - F.expr("INTERVAL 1 HOUR")) & (F.col("component") == component))
    exact = mo.performance_summary(inside).first()
    assert want[end, component] == pytest.approx(tuple(exact[c] for c in cols))


def test_sliding_percentiles_of_nulls_and_many_values(spark):
    rows = spark.range(20000).select(
        F.timestamp_seconds(F.lit(1704067200)).alias("ts"), F.when(F.col("id") == 0, "empty").otherwise("full").alias("component"),
        F.when(F.col("id") > 0, F.pmod(F.col("id") * 7919, F.lit(19999)).cast("double")).alias("duration"), F.lit(True).alias("success"))
    got = {r.component: r for r in sm.sliding_performance(rows, "5 minutes", "5 minutes").collect()}
    assert got["empty"].total_requests == 1 and got["empty"].median_response_time is None and got["empty"].p99_response_time is None
    for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(got["full"][f"{name}_response_time"] - p * 19999) <= 0.01 * 19999


def test_sliding_accuracy_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"), F.lit("q").alias("query_type"),
                                   (F.col("id") % 10 / 10.0).alias("confidence"), (F.col("id") % 7 / 7.0).alias("uncertainty"))
    rows.write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "a"))
    got = {r.ts: tuple(r) for r in run(sm.sliding_accuracy(stream, retention="10 minutes"), "sliding_accuracy").collect()}
    want = {r.ts: tuple(r) for r in sm.sliding_accuracy(rows).collect()}
    assert got and all(want[k][1:] == pytest.approx(v[1:]) for k, v in got.items())


def test_alerts_of_recorded_events_equal_the_stream_gate(spark, tmp_path):
    at = lambda m: F.timestamp_seconds(F.lit(1704067200) + m)
    minutes = spark.range(400).where("id < 130 OR id BETWEEN 200 AND 202 OR id > 390")
    perf = minutes.select(at(F.col("id") * 60).alias("ts"), F.lit(9.0).alias("duration"), (F.col("id") != 201).alias("success"))
    acc = minutes.limit(0).select(at(F.col("id")).alias("ts"), F.lit(0.1).alias("confidence"), F.lit(0.1).alias("uncertainty"))
    stats = mo.trailing_stats(perf, acc)
    first = stats.orderBy("ts").first()
    assert first.ts.timestamp() % 60 == 0 and first.avg_confidence is None and first.error_rate == 0
    got = {(r.name, r.ts) for r in mo.alerts(perf, acc).collect()}

    def plain(hits):
        last = {}
        for name, ts in sorted(hits, key=lambda h: h[1]):
            if name not in last or (ts - last[name]).total_seconds() > 3600:
                last[name] = ts
                yield name, ts

    hits = [(r.name, r.ts) for r in mo.alert_candidates(stats).collect()]
    assert got == set(plain(hits)) and {n for n, _ in got} == {"slow_response_time", "high_error_rate"} and len(got) == 6
    stats.coalesce(1).write.parquet(str(tmp_path / "stats"))
    stream = spark.readStream.schema(stats.schema).parquet(str(tmp_path / "stats"))
    assert {(r.name, r.ts) for r in run(st.alerts(stream), "recorded").collect()} == got
    assert mo.alerts(perf.limit(0), acc).count() == 0


def test_cumulative_equals_batch(spark, events):
    stream = run(sm.cumulative_components(sm.read_events(spark, events, "perf_events")), "cumulative", "complete")
    cols = ["component", "total_requests", "error_count"]
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, mo.component_statistics(spark.read.parquet(events)).select(*cols).collect()))


def test_alert_refire(spark, tmp_path):
    rows = [(t, 0.5) for t in (0, 1800, 3600, 3601)]
    df = spark.createDataFrame(rows, "s LONG, error_rate DOUBLE").select(F.timestamp_seconds("s").alias("ts"), "error_rate")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = run(st.alerts(stream), "alerts").select(F.unix_timestamp("ts").alias("s"), "name").collect()
    assert sorted((r.s, r.name) for r in got) == [(0, "high_error_rate"), (3601, "high_error_rate")]
    seen = []
    own = [("half", "error_rate >= 0.5 AND total IS NULL", "info", "own rule")]
    q = st.deliver(mo.alert_candidates(stream, own), [lambda rows, i: seen.append(rows.count())], str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 4


def test_reliability_stream_equals_batch(spark, tmp_path):
    rows = [("neural", b, 1 if b != 2 else 0, 0 if b != 2 else 1, 0, 0) for b in (1, 2, 3)]
    df = spark.createDataFrame(rows, "source_type STRING, batch INT, tp LONG, fp LONG, fn LONG, tn LONG")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    got = run(st.reliability(spark.readStream.schema(df.schema).parquet(str(tmp_path / "c"))), "rel", "update").collect()
    assert got[-1].accuracy == pytest.approx(0.800650) and got[-1].batches == 3


def test_conversation_stream(spark, tmp_path):
    rows = [(1, t, None, "pain" if t == 0 else "", [(f"e{t % 2}", "SYMPTOM", 0.9)], "") for t in range(13)]
    from evigraph.schemas import schema

    spark.createDataFrame(rows, schema("turns")).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = run(st.conversation_context(spark.readStream.schema(schema("turns")).parquet(str(tmp_path / "t"))), "conv").orderBy("turn").collect()
    assert len(got) == 13 and got[12].kept_turns == 10 and got[12].overlapping_turns == [10] and got[0].topics == ["symptom", "symptom_pain"]


def test_entity_timeline_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, f"e{t % (2 + c)}", round(0.5 + (t * 7 % 11) / 25, 2)) for c in (1, 2) for t in range(25)] + [(1, 3, None, 0.5), (2, 4, "e0", 0.1)]
    df = spark.createDataFrame(rows, "conv_id LONG, turn_no INT, entity STRING, confidence DOUBLE")
    for part in range(4):  # every file holds turns from all over the conversation, so some come late
        df.where(F.coalesce(F.pmod("turn_no", F.lit(4)), F.lit(0)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = {}
    for r in run(st.entity_timeline(stream), "timeline", "update").collect():
        if r.mentions > got.get((r.conv_id, r.entity), (0,))[0]:
            got[r.conv_id, r.entity] = (r.mentions, r.first_mention, r.last_mention, r.confidence_trend)
    want = {(r.conv_id, r.entity): (r.mentions, r.first_mention, r.last_mention, r.confidence_trend)
            for r in cv.entity_timeline(df.where("entity is not null")).collect()}
    assert len(want) == 7 and got == want


def test_ingest_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(f"f{i}", "Lab report " + "x" * (600 * i)) for i in range(5)], "source_file STRING, text STRING")
    docs.write.parquet(str(tmp_path / "in"))
    q = ing.ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    stored = rd.read_collections(spark, str(tmp_path / "out"))
    assert stored.count() == ing.chunk_stream(docs).count() and {r.collection for r in stored.collect()} == {"patient_records"}
    wr.drop_collections(spark, str(tmp_path / "out"), str(tmp_path / "out2"), ["clinical_notes"])
    assert rd.read_collections(spark, str(tmp_path / "out2")).count() == stored.count()


def test_graph_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b")], "entity_id STRING, feature STRING")
    names = spark.createDataFrame([("1", "one"), ("2", "two")], "entity_id STRING, entity STRING")
    tables = gr.build_graph(wt.combined_weights(pairs), names, 0.0)
    wr.write_graph(*tables, str(tmp_path / "g"))
    wr.upsert_graph(spark, str(tmp_path / "g"), *tables, str(tmp_path / "g2"))
    e, f, ed = rd.read_graph(spark, str(tmp_path / "g2"))
    assert (e.count(), f.count(), ed.count()) == (2, 2, 3)
    assert rd.read_kb_names(e, f).count() == 4
    with pytest.raises(ValueError):
        wr.upsert_graph(spark, str(tmp_path / "g"), *tables, str(tmp_path / "g"))


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    edge = "entity_id STRING, feature_id STRING, weight DOUBLE, tfidf_weight DOUBLE, pmi_confidence DOUBLE, category STRING"
    node = "id STRING, name STRING, display_name STRING"
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    nodes = lambda ids, name: spark.createDataFrame([(i, name, name.title()) for i in ids], node)
    edges = lambda rows: spark.createDataFrame([(e, f, w, w, w, "low") for e, f, w in rows], edge)
    hub = [("hub", f"s{i}", 0.5) for i in range(200)]
    gs.create_store(nodes(["hub"], "old"), nodes([f"s{i}" for i in range(200)], "old"), edges(hub), path, at(1), buckets=16)
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    before = files()
    gs.merge_store(spark, path, nodes(["hub", "next"], "new"), nodes(["s0", "t"], "new"), edges([("hub", "s0", 0.9), ("next", "t", 0.3)]), at(2))
    after = files()
    entities, features, merged = gs.read_store(spark, path)
    assert {(r.id, r.name) for r in entities.collect()} == {("hub", "old"), ("next", "new")}
    assert features.count() == 201 and features.where("id = 's0'").first().name == "old"
    got = {(r.entity_id, r.feature_id): (r.weight, r.updated_at.day) for r in merged.collect()}
    assert got == {**{(e, f): (w, 1) for e, f, w in hub}, ("hub", "s0"): (0.9, 2), ("next", "t"): (0.3, 2)}
    rewritten = {f.split("/")[1] for f in before if f.startswith("edges") and f not in after}
    assert 1 <= len(rewritten) <= 2
    assert all(after.get(f) == m for f, m in before.items() if not (f.startswith("edges") and f.split("/")[1] in rewritten))
    gs.merge_store(spark, path, nodes(["hub", "next"], "new"), nodes([], "new"), edges([]), at(3))
    assert files().keys() >= after.keys() and gs.read_store(spark, path)[2].count() == 201


def test_tables_round_trip(spark, tmp_path):
    w = spark.createDataFrame([("1", "D", "A b", 0.5)], "disease_id STRING, disease STRING, symptom STRING, weight DOUBLE")
    wr.write_table(w, str(tmp_path / "w"), ("csv", "parquet"))
    r = rd.read_weights(spark, str(tmp_path / "w" / "csv")).first()
    assert (r.frequency_weight, r.tfidf_weight, r.symptom_id) == (0.5, 0.5, "symptom::a_b")
    d = spark.createDataFrame([("1", "Flu", 'fever, "x"')], "disease_id STRING, disease STRING, common_symptom STRING")
    wr.write_table(d, str(tmp_path / "d"), ("csv",))
    assert rd.read_disease_table(spark, str(tmp_path / "d")).first().common_symptom == 'fever, "x"'
    rec = tmp_path / "c.jsonl"
    rec.write_text('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}\n')
    assert [(r.turn, r.role, r.text) for r in rd.read_conversation_records(spark, str(rec)).orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    ts = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    none = spark.createDataFrame([], rd.schema("messages"))
    ex = spark.range(1).select(F.lit("c").alias("conv_id"), F.lit("u").alias("user_id"), F.lit("hi").alias("query"), F.lit("yo").alias("response"), ts.alias("ts"))
    wr.save_exchange(none, ex, str(tmp_path / "m"))
    assert [r.text for r in rd.read_messages(spark, str(tmp_path / "m"), "c").collect()] == ["hi", "yo"]
    with ing.timed(spark, str(tmp_path / "p"), "job", "x"):
        pass
    assert spark.read.parquet(str(tmp_path / "p")).first().success
    stats = spark.createDataFrame([(1,)], "n INT")
    wr.write_statistics(stats, str(tmp_path / "s"))
    wr.write_split(spark.createDataFrame([(1, "train"), (2, "test")], "id INT, part STRING"), str(tmp_path / "sp"))
    assert spark.read.json(str(tmp_path / "sp")).count() == 2


def test_default_reliability(spark):
    assert fu.default_reliability(spark).count() == 4
