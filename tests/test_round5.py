"""Work that grows with pairs stays off the disk: blocks of vectors in rounds."""

import collections

import numpy as np


def test_near_vectors_in_rounds_shuffle_no_block(spark, monkeypatch):
    from evigraph.llm import blocks, vectordup

    monkeypatch.setattr(blocks.block_numbers, "__defaults__", (20,))
    monkeypatch.setattr(vectordup, "ROUND_BYTES", 3 * 20 * 8 * 4)
    rounds, own = [], vectordup._rounds
    monkeypatch.setattr(vectordup, "_rounds", lambda sizes, limit: rounds.extend(own(sizes, limit)) or list(rounds))
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    given = {i: (base[i % 40] + rng.normal(scale=0.1, size=8)).astype(np.float32) for i in range(160)}
    given |= {i: given[i - 160] for i in range(160, 200)} | {i: rng.normal(size=5).astype(np.float32) for i in range(200, 210)}
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in given.items()], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectordup.near_vectors(table).collect()}
    links, near = collections.Counter(), {i: {i} for i in given}
    for i, a in given.items():
        for j, b in given.items():
            a, b = a.astype(float), b.astype(float)
            if i < j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                links.update((i, j))
                both = near[i] | near[j]
                for k in both:
                    near[k] = both
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (links[i], min(near[i])) for i in given}
    # every block is sent in one round, and there are several rounds
    assert len(rounds) > 3 and len({k for r in rounds for k in r}) == sum(len(r) for r in rounds)
    assert own([(8, 1, 60), (8, 0, 60), (5, 0, 200), (8, 2, 60)], 120) == [[(5, 0)], [(8, 0), (8, 1)], [(8, 2)]]


def test_tokens_are_labelled_and_decoded_in_small_batches(spark):
    from pyspark.sql import functions as F

    from evigraph.operators import corpus as cp
    from evigraph.session import tune

    ann = "array<struct<entity:string,display_name:string,position:int>>"
    rows = [("a", "Öl ist nicht_gut, 😀😀!", [("ist", "", 3)], [("gut", "", 13), ("nicht_gut", "", 7)]),
            ("b", "", [], []), ("c", None, [], []), ("d", "x y", None, None), ("e", "\x1cz", None, [("z", "", 1)]), ("f", "p q r", [("p q", "", 0)], None)]
    labelled = cp.label_arrays(spark.createDataFrame(rows, f"id string, text string, diseases {ann}, symptoms {ann}"))
    got = {r.id: r.labelled and [(t.token, t.start, t.end, t.label) for t in r.labelled] for r in labelled.collect()}
    assert got == {
        "a": [("Öl", 0, 2, "O"), ("ist", 3, 6, "B-DISEASE"), ("nicht_gut", 7, 16, "B-SYMPTOM"), (",", 16, 17, "O"), ("😀", 18, 19, "O"),
              ("😀", 19, 20, "O"), ("!", 20, 21, "O")],
        "b": [], "c": None, "d": [("x", 0, 1, "O"), ("y", 2, 3, "O")], "e": [("\x1c", 0, 1, "O"), ("z", 1, 2, "B-SYMPTOM")],
        "f": [("p", 0, 1, "B-DISEASE"), ("q", 2, 3, "I-DISEASE"), ("r", 4, 5, "O")]}
    # nothing is done token by token outside the Arrow pass, whose batches are small
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "lambdafunction" not in plan.split("_tokens")[0].split("Project")[0]
    assert tune(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"

    token = "array<struct<start:int,end:int,label:string,confidence:double>>"
    rows = [("a", "one two 😀 four", [(0, 3, "I-X", 0.1), (0, 3, "B-X", 0.2), (4, 7, "I-Y", 0.9), (8, 9, "I-X", 0.7), (None, 9, "I-X", None), (10, 14, "O", 0.5), (10, 14, "I-X", 1.0)]),
            ("b", "p q", [(0, 1, "B-", None), (2, 3, "B-X", 0.5)]), ("c", "p", []), ("d", None, [(0, 1, "B-X", 0.3), (1, 2, None, 0.4), (1, 5, "I-X", 0.2)]), ("e", "p", None)]
    out = cp.decode_arrays(spark.createDataFrame(rows, f"id string, text string, labelled {token}")).orderBy("id", "start")
    assert [tuple(r) for r in out.collect()] == [
        ("a", 0, 9, "X", "one two 😀", 0.7), ("b", 0, 1, "", "p", None), ("b", 2, 3, "X", "q", 0.5), ("d", 0, 5, "X", None, 0.3)]
    assert cp.decode_arrays(labelled.withColumn("labelled", F.transform("labelled", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label"), F.lit(0.9).alias("confidence"))))).count() == 4


def test_bags_meet_entities_in_rounds_without_a_shuffle_of_matches(spark, monkeypatch):
    import math
    import random

    from evigraph.operators import product as pt

    for name, value in (("ROUND_ITEMS", 20), ("EDGES", 30), ("MATCHES", 25)):
        monkeypatch.setattr(pt, name, value)
    rng = random.Random(3)
    names = [f"f{i}" for i in range(9)]
    edges = [(e, f, rng.choice([0.3, 0.45, 0.5000000004, 0.5000000006, 0.9])) for e in [None, *range(60)] for f in rng.sample(names, rng.randrange(1, 4))]
    bags = {b: rng.sample([*names, "unknown"], rng.randrange(1, 4)) for b in range(30)} | {99: ["unknown"]}
    items = spark.createDataFrame([(b, f) for b, fs in bags.items() for f in fs] + [(98, None)], "bag_id long, feature_id string")
    entities = pt.entity_rows(spark.createDataFrame(edges + edges[:1], "entity_id long, feature_id string, weight double"))
    scores = collections.defaultdict(lambda: collections.defaultdict(list))
    for e, f, w in edges + edges[:1]:
        for b, fs in bags.items():
            if f in fs:
                scores[b][e].append(w)
    order = lambda e: -1 if e is None else e
    want = {b: sorted(own, key=lambda e: (-round(sum(own[e]), 9), -len(own[e]), order(e)))[:4] for b, own in scores.items()}
    got = collections.defaultdict(list)
    rows = pt.best_entities(items, entities, 4).collect()
    for r in rows:
        got[r.bag_id].append((-round(r.total_score, 9), -r.matched_count, order(r.entity_id), r.entity_id))
    assert {b: [x[-1] for x in sorted(own, key=lambda x: x[:3])[:4]] for b, own in got.items()} == want
    # far fewer rows than matches, and some, as each task keeps its best
    assert len(rows) < sum(len(own) for own in scores.values())

    parts = {r.bag_id: r for r in pt.softmax_parts(items, entities, 2.0).collect()}
    assert set(parts) == set(scores)
    for b, own in scores.items():
        s = [sum(w) / 2 for w in own.values()]
        assert parts[b].k == len(s) and math.isclose(parts[b].m, max(s)) and math.isclose(parts[b].z, sum(math.exp(x - max(s)) for x in s))
    assert pt.best_entities(items.where("bag_id = 99"), entities, 4).count() == pt.best_entities(items.limit(0), entities, 4).count() == 0
    assert pt.rounded_keys(np.array([0.1234567885, 0.1234567895, 2.5e-10, -1.0]), 9).tolist() == [123456789, 123456790, 0, -1e9]
