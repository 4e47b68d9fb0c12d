"""Line items are joined and counted once for the graphs of the early and of all years; a slug is made once a feature."""

import collections
import math

from pyspark.sql import functions as F

from evigraph.operators import graph as gr
from evigraph.operators import weights as wt
from evigraph.plans import queries_weights as qw
from evigraph.plans import tables


def test_graph_merge_joins_line_items_once(spark, tmp_path, monkeypatch):
    # order 3 comes twice, in an early and a late year and of two customers: all its lines are early ones
    days = {1: [(10, "1995-05-01")], 2: [(10, "1998-05-01")], 3: [(11, "1996-01-01"), (12, "1998-01-01")], 4: [(12, "1998-06-01")],
            5: [(None, "1995-01-01")], 6: [(10, None)]}
    orders = [(k, c, d) for k, rows in days.items() for c, d in rows] + [(None, 13, "1995-01-01")]
    parts = [(1, "red nut"), (2, "Red-nut"), (3, "bolt"), (4, None), (5, "cog")]
    lines = [(1, 1), (1, 3), (2, 1), (2, 2), (3, 3), (3, 5), (4, 5), (4, 2), (5, 1), (6, 5), (3, 4), (None, 1), (4, None)]
    frames = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.col("d").cast("timestamp")),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long"),
        "part": spark.createDataFrame(parts, "p_partkey long, p_name string"),
        "customer": spark.createDataFrame([(c, f"Customer#{c}") for c in (10, 11, 12, 13)], "c_custkey long, c_name string"),
    }
    read = collections.Counter()

    def table(_, __, name):
        read[name] += 1
        return frames[name]

    monkeypatch.setattr(tables, "table", table)
    monkeypatch.setattr(qw, "table", table)
    names = dict(parts)

    def edges(early):
        bag = collections.Counter()
        for k, p in lines:
            for c, _ in days.get(k, []):
                if p in names and (not early or any(d and d < "1997" for _, d in days[k])):
                    bag[c, names[p]] += 1
        entity, feature, df = collections.Counter(), collections.Counter(), collections.Counter()
        for (c, f), n in bag.items():
            entity[c] += n
            feature[f] += n
            df[f] += 1
        total = sum(bag.values())
        tfidf = {(c, f): n / entity[c] * math.log(len(entity) / df[f]) for (c, f), n in bag.items()}
        # rows without a customer or a name count in the totals only
        tfidf = {k: v for k, v in tfidf.items() if None not in k}
        top, out = max(tfidf.values()), {}
        for c, f in sorted(tfidf):
            ppmi = max(0.0, math.log(bag[c, f] * total / (entity[c] * feature[f])))
            w = 0.7 * (tfidf[c, f] / top if top else 0) + 0.3 * (1 - math.exp(-ppmi))
            if w >= qw.MIN_WEIGHT:
                out[str(c), "symptom::" + f.lower().replace(" ", "_").replace("-", "_")] = round(w, 5)
        return out

    first, full = edges(True), edges(False)
    want = {k: (w, "1997-01-01") for k, w in first.items()} | {k: (w, "1999-01-01") for k, w in full.items()}
    got = qw.graph_merge(spark, str(tmp_path)).collect()
    assert {(r.source_id, r.target_id): (round(r.weight, 5), r.updated) for r in got if r.kind == "edge"} == want
    assert {r.source_id for r in got if r.kind == "entity"} == {c for c, _ in want}
    assert sorted(r.source_id for r in got if r.kind == "feature") == sorted({f for _, f in want})
    assert first.keys() - full.keys() or first != full
    assert (read["lineitem"], read["orders"], read["part"]) == (1, 1, 1)


def test_slugs_are_made_once_a_feature(spark):
    schema = "entity_id long, feature string, final_weight double, tfidf_weight double, pmi_confidence double, weight_category string"
    rows = [(2, "a b", 0.5, 0.1, 0.2, "x"), (1, "a-b", 0.6, 0.3, 0.4, "y"), (2, "a-b", 0.7, 0.5, 0.6, "z"), (None, "A b", 0.9, 0.1, 0.1, "x"), (3, "c", 0.1, 0.1, 0.1, "x"), (1, None, 0.4, 0.1, 0.1, "x")]
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "entity_id long, entity string")
    entities, features, edges = gr.build_graph(spark.createDataFrame(rows, schema), names, 0.2)
    assert "regexp_replace" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.name) for r in features.collect()} == {("symptom::a_b", "A b"), (None, None)}
    assert {r.id for r in entities.collect()} == {1, 2}
    assert {tuple(r) for r in edges.collect()} == {
        (2, "symptom::a_b", 0.7, 0.5, 0.6, "z"), (1, "symptom::a_b", 0.6, 0.3, 0.4, "y"),
        (None, "symptom::a_b", 0.9, 0.1, 0.1, "x"), (1, None, None, None, None, None)}


def test_marked_counts(spark):
    pairs = spark.createDataFrame([(1, "a", True), (1, "a", None), (1, "a", False), (2, "b", None)], "entity_id long, feature string, late boolean")
    assert {tuple(r) for r in wt.pair_counts(pairs, "late").collect()} == {(1, "a", 3, 1), (2, "b", 1, 0)}
