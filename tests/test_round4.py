"""Chunks that cannot be reached are left out before their vectors are made; signs of contexts are drawn once."""

import collections
import math
import random

from evigraph.operators import retrieval as rt
from evigraph.operators import walks as wk


def test_only_chunks_within_reach_get_vectors(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(60)]
    texts = {i: rng.choices(names, weights=[1 / (j + 1) for j in range(60)], k=12) for i in range(80)}
    asked = {i: texts[i][:8] + rng.choices(names, k=2) for i in range(6)}
    chunks = spark.createDataFrame([("c", i, " ".join(t), {"source_file": "s"}) for i, t in texts.items()], "collection string, chunk_id long, text string, metadata map<string,string>")
    queries = spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()], "query_id long, text string")
    df = collections.Counter(w for t in texts.values() for w in set(t))
    idf = {w: math.log((len(texts) + 1) / (n + 1)) for w, n in df.items()}

    def vector(words):
        x = {w: n * idf[w] for w, n in collections.Counter(words).items() if idf.get(w, 0) > 0}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()}

    held = {i: vector(t) for i, t in texts.items()}
    want = {}
    for q, words in asked.items():
        a = vector(words)
        near = sorted((round(2 - 2 * sum(v * held[i].get(w, 0) for w, v in a.items()), 9), i) for i in texts)
        want[q] = [i for d, i in near if d <= 1 + 1e-9][:5]
    got = collections.defaultdict(list)
    for r in sorted(rt.retrieve(queries, chunks).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.chunk_id)
    assert dict(got) == {q: ids for q, ids in want.items() if ids}

    from pyspark.sql import functions as F

    words = chunks.select(F.col("chunk_id").alias("id"), F.explode(F.array_distinct(F.split("text", " "))).alias("term"))
    vectors = rt.term_weights(queries, "query_id", "text", rt.inverse_frequency(words))
    reached = {r.chunk_id for r in rt.reachable(vectors, words, chunks).collect()}
    assert {i for ids in want.values() for i in ids} <= reached and len(reached) < len(texts)
    # rows with one id count once each, so their chunk is reached from farther away
    assert reached < {r.chunk_id for r in rt.reachable(vectors, words, chunks.unionByName(chunks).unionByName(chunks)).collect()}


def test_signs_are_not_drawn_for_every_neighbour(spark):
    walks = spark.createDataFrame([("d::1", 0, ["d::1", "s::a", "d::2", "s::b"]), ("d::2", 0, ["d::2", "s::b", "d::1", "s::a"])], "start string, walk int, path array<string>")
    out = wk.projected_embeddings(walks, 70, 5)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["_n"]: r["embedding"] for r in out.collect()}
    assert set(rows) == {"d::1", "d::2", "s::a", "s::b"} and all(len(v) == 70 for v in rows.values())
