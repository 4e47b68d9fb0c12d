"""The training-data operators against plain versions on small tables, edge cases included."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tuned(spark, tmp_path_factory):
    from evigraph.session import tune

    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return tune(spark)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_docs(spark, extra=()):
    """Nulls in every column, empty and repeated rows, a long text, and columns with clashing names."""
    long = words(30_000, 1, 5_000)
    rows = [
        (1, words(60, 2), "en", "a", 1), (2, words(60, 2), "en", "a", 1), (2, words(60, 2), "en", "a", 1),
        (3, "", "en", "b", 0), (4, None, None, None, None), (None, words(40, 3), "en", None, 5),
        (5, long, "de", "c", 9), (6, " \t\n", "en", "b", 3), (7, "one", "en", "b", 3), (8, "é" * 150 + " é\x0b漢", "fr", "é", 3),
        (None, None, None, None, None), *extra,
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["k1", "size", "score", "tid", "row", "_row", "target", "piece", "bands", "shard", "text_crc32", "label", "copies"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# 1 quality -----------------------------------------------------------------------------------------


def quality_corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        text = "\n".join(words(12, 7 * i + k).capitalize() + "." for k in range(4))
        good = i % 4 != 1
        if not good:
            lines = text.split("\n")
            lines[i % 4] = "BUY!! NOW!! CLICK!! HERE!! " * 6
            text = "\n".join(lines)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_holds_on_rows_it_never_learnt_from(tuned):
    from evigraph.llm.quality import classify

    docs, labels = quality_corpus(tuned)
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == 240
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 != 1) for r in held) / len(held) >= 0.95


def test_quality_edge_cases(tuned):
    from evigraph.llm.quality import classify, keep_good, line_features

    docs, labels = quality_corpus(tuned, 80)
    odd = odd_docs(tuned)
    rows = classify(odd, labels.withColumn("text", F.lit("x"))).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert classify(empty_docs(tuned), labels).count() == 0
    assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {1.0}
    assert keep_good(odd, labels).columns == odd.columns
    # a text over the block size gives the features that its lines have
    line = ("abc Def 12, " * 30).strip()
    one = b"\n".join([line.encode()] * 5000)
    x, length, owner = next(iter(line_features([one])))
    y = next(iter(line_features([b"\n".join([line.encode()] * 3)])))[0]
    assert np.allclose(x[1], y[1]) and len(length) == 5000 and set(owner) == {0}


def test_counts_of_long_lines_are_added_up(monkeypatch):
    from evigraph.llm import quality

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab Z9.!\té漢\n" if rng.random() < 0.2 else "ab Z!") for _ in range(rng.randrange(1, 400))).encode() for _ in range(60)]
    texts += [b"a a a!" * 90, b"\n" * 70, b"x" * 300 + b"\n", b"go go  " * 40 + b"\n\nlast", b" " * 200]
    want = [next(iter(quality.line_features([t]))) for t in texts]
    monkeypatch.setattr(quality, "BLOCK", 20)
    for part in (1, 7, 64):
        monkeypatch.setattr(quality, "PART", part)
        for t, (x, length, owner) in zip(texts, want):
            got = next(iter(quality.line_features([t])))
            assert np.allclose(got[0], x) and (got[1] == length).all() and (got[2] == owner).all()


def test_quality_learns_from_whole_texts_and_any_labels(tuned):
    from evigraph.llm.quality import classify, train

    docs, labels = quality_corpus(tuned, 120)
    # bad only after 600 good lines; a line of a megabyte; null, other and contradicting labels
    good = "\n".join(words(8, k).capitalize() + "." for k in range(600))
    more = tuned.createDataFrame([(1000 + i, good + "\n" + "BUY!! NOW!! CLICK!! " * 400 * (i % 2), "en", "s", 1) for i in range(40)] + [(2000, "BUY!! " * 180_000, "en", "s", 1)], DOCS)
    told = tuned.createDataFrame([(1000 + i, 1 - i % 2) for i in range(40)] + [(0, None), (0, 0), (4, 7), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs.unionByName(more), labels.unionByName(told)).collect()}
    late = [got[1000 + i] for i in range(40)]
    assert sum(r.predicted == 1 - i % 2 for i, r in enumerate(late)) >= 36
    assert got[2000].predicted == 0
    # the line budget leaves out rows, never parts of them
    assert train(docs, labels, lines=3) is None and train(docs, labels, lines=40) is not None


def test_marginals_equal_enumeration():
    from evigraph.llm.quality import marginals

    rng = np.random.default_rng(3)
    scores, move = rng.normal(size=5), rng.normal(size=(2, 2))
    owner = np.array([0, 0, 0, 1, 1])
    bad, _ = marginals(scores, move, owner)
    for chain in ([0, 1, 2], [3, 4]):
        total, on = 0.0, np.zeros(len(chain))
        for code in range(2 ** len(chain)):
            y = [code >> k & 1 for k in range(len(chain))]
            p = np.exp(sum(scores[i] * b for i, b in zip(chain, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += p
            on += p * np.array(y)
        assert np.allclose(bad[chain], on / total)


# 2 token counts, 9 packing ---------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    from evigraph.llm.tokens import default_tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


TRICKY = [
    "İstanbul İ don't it's 'S a<|endoftext|>b <|startoftext|> x y", "é É 1234 ²³ ½ ΣΑΣ. ΣΑΣ, the end “q” hi...!!! a.b c_d ﬁ ǅ K ́x",
    " lead and trail \n", "　wide space line", "", None, "WE'LL we'll we''ll ?!x", "漢字 かな",
]


def test_ids_are_those_of_the_tokenizer():
    import pyarrow as pa

    from evigraph.llm.tokens import default_tokenizer, encode_texts

    texts = [*TRICKY, words(500, 9)]
    for text, got in zip(texts, encode_texts(pa.array(texts, pa.string()), default_tokenizer()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain_ids(text)


def test_words_known_before_outlive_an_emptied_memory(monkeypatch):
    import pyarrow as pa

    from evigraph.llm import tokens

    monkeypatch.setattr(tokens, "_state", {})
    monkeypatch.setattr(tokens, "REMEMBERED", 6)
    texts = [words(200, 10, 400), *TRICKY]
    for n in (1, 2, 4, 9, 40, 200, 3):  # each batch has the words of the one before, and more
        batch = [" ".join(texts[0].split()[:n]), f"w1, {texts[1 + n % len(TRICKY)] or ''}", None]
        for text, got in zip(batch, tokens.encode_texts(pa.array(batch, pa.string()), tokens.default_tokenizer()), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain_ids(text)


def test_ids_of_made_up_texts_are_those_of_the_tokenizer(monkeypatch):
    import pyarrow as pa

    from evigraph.llm import tokens

    rng = random.Random(5)
    letters = ["İ", "İ", "I", "ı", "ß", "ẞ", "ﬁ", "ǅ", "Σ", "ς", "é", "e\u0301", "\u0307", "a", "b", "ʼn", "ŉ", "漢", "ǰ", "ΐ", "ա", "և", "Ⅷ"]
    marks = ["!", ".", ",", "'", "''", "'s", "’", "-", "_", "$", "“", "…", "1", "²", "\u200b", "\u200d", "\x00", "\x1c", "\x7f", "\xa0", "\u2028", " ", " ", "\n", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.6 else marks) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    texts = [" ".join(texts[i : i + 4]) for i in range(0, len(texts), 4)] + texts[:1500]
    monkeypatch.setattr(tokens, "_state", {})
    monkeypatch.setattr(tokens, "GATHERED", 50)
    whole = pa.array([None, *texts], pa.string())
    for part, want in ((whole, [None, *texts]), (whole.slice(700, 90), texts[699:789])):  # also a slice of an array
        for text, got in zip(want, tokens.encode_texts(part, tokens.default_tokenizer()), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain_ids_kept(text), repr(text)


_kept = {}


def plain_ids_kept(text):
    if "t" not in _kept:
        from tokenizers import Tokenizer

        from evigraph.llm.tokens import default_tokenizer

        _kept["t"] = Tokenizer.from_file(default_tokenizer())
        _kept["t"].encode_special_tokens = True
    return _kept["t"].encode(text or "", add_special_tokens=False).ids


def test_histogram_answers_every_limit(tuned):
    from evigraph.llm.tokens import context_limits, token_histogram

    docs = odd_docs(tuned)
    lengths = [len(plain_ids(r.text)) for r in docs.select("text").collect()]
    rows = token_histogram(docs).collect()
    for r in rows:
        assert r.docs == lengths.count(r.tokens)
        assert r.longer_docs == sum(x > r.tokens for x in lengths)
        assert r.longer_tokens == sum(x for x in lengths if x > r.tokens)
        assert r.truncated_total == sum(min(x, r.tokens) for x in lengths)
        assert r.total_tokens == sum(lengths) and abs(r["quantile"] - sum(x <= r.tokens for x in lengths) / len(lengths)) < 1e-12
    assert sorted(r.tokens for r in rows) == sorted(set(lengths))
    for r in context_limits(token_histogram(docs), [1, 50, 10**6]).collect():
        assert (r.fitting_docs, r.truncated_total) == (sum(x <= r.context for x in lengths), sum(min(x, r.context) for x in lengths))
    assert token_histogram(empty_docs(tuned)).count() == 0


def test_packing_is_a_round_trip(tuned):
    from evigraph.llm.packing import pack_documents

    docs = odd_docs(tuned, [(100 + i, words(50 + 37 * i % 900, i), "en", "a", 1) for i in range(60)])
    size = 512
    rows = pack_documents(docs, size).collect()
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain_ids(r.text), 1]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= -(-sum(r.length for r in rows) // size) + 2
    assert pack_documents(empty_docs(tuned), size).count() == 0


def test_local_search_empties_bins_that_best_fit_leaves():
    from evigraph.llm.packing import Bins, improve

    sizes = [6, 3, 5, 5, 4, 4, 3]
    bins = Bins(10)
    for items in ([0, 1], [2, 4], [3, 5], [6]):
        bins.items.append([])
        bins.free.append(10)
        b = len(bins.items) - 1
        bins.index(b)
        for i in items:
            bins.put(b, i, sizes[i])
    improve(bins, sizes)
    assert sum(1 for x in bins.items if x) == 3
    assert sorted(i for x in bins.items for i in x) == list(range(7))
    assert all(sum(sizes[i] for i in x) == 10 - f for x, f in zip(bins.items, bins.free))


# 3 top-k, 5 near vectors -----------------------------------------------------------------------------


def vector_table(spark, n=700):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(n, 12))
    base[100:160] = base[100] + rng.normal(scale=0.15, size=(60, 12))
    base[200:210] = base[200]
    rows = [(int(i), [float(x) for x in np.float32(v)], 1) for i, v in enumerate(base)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1050, [0.0] * 12, 1), (1100, [nan] + [1.0] * 11, 1), (1101, [inf] + [1.0] * 11, 1), (1102, [None] + [1.0] * 11, 1), (1150, [1.0, 2.0], 1), (1151, [1.0, 2.0], 1), (1200, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_exact(tuned, monkeypatch, small):
    from evigraph.llm import blocks, topk

    if small:
        monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    table = vector_table(tuned).withColumn("score", F.lit(1)).withColumn("tid", F.lit(1))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table).collect()}
    rows = {}
    for r in table.collect():
        if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding):
            rows[r.vec_id] = np.floor(256 * np.array(r.embedding, dtype=float)).astype(int)
    want = {}
    for q in (x for x in rows if x % 50 == 0):
        best = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))[:5]
        want.update({(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)})
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0
    assert blocks.BLOCK > 0


def test_near_vectors_equal_brute_force(tuned, monkeypatch):
    from evigraph.llm import blocks, vectordup

    monkeypatch.setattr(blocks.block_numbers, "__defaults__", (150,))
    table = vector_table(tuned).withColumn("links", F.lit(1)).withColumn("k1", F.lit(1))
    got = {r.vec_id: r for r in vectordup.near_vectors(table).collect()}
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    ok = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i in vectors}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = collections.Counter()
    for i, a in ok.items():
        for j, b in ok.items():
            if i < j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], find(i), find(i) == i) for i in vectors}
    assert vectordup.near_vectors(table.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    from evigraph.llm.vectordup import links_between

    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 16))
    b = a[::2] + rng.normal(scale=0.2, size=(150, 16))
    rows, cols, looked = links_between(a, b, 0.9)
    cosine = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert set(zip(rows.tolist(), cols.tolist())) == set(zip(*np.nonzero(cosine >= 0.9)))
    assert len(rows) <= looked < 0.1 * cosine.size


# 4 mixing --------------------------------------------------------------------------------------------


def filled(sizes, weights, cap):
    """Targets by rounds of clamping and resharing."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not over:
            return [fixed.get(i, weights[i] * level if free else 0) for i in range(len(sizes))]
        fixed.update({i: cap * sizes[i] for i in over})


def test_mix_fills_to_targets(tuned):
    from evigraph.llm.mixing import apply_mix, mix

    extra = [(100 + i, words(1 + i * 13 % 90, i), "en", "abcde"[min(i % 11, 4)], 1) for i in range(200)]
    docs = odd_docs(tuned, extra)
    rows = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(names, filled([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)))
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 2 for s in names)
    mixed = apply_mix(docs)
    assert mixed.columns == docs.columns
    words_of = collections.Counter()
    for r in mixed.collect():
        words_of[r.source] += len((r.text or "").split())
        assert r.text is None or r.n_chars == len(r.text)
    # str.split knows more white space than the operator; the fixture has none of it
    assert all(words_of[s] == taken[s] for s in names)
    assert mix(empty_docs(tuned)).count() == 0 and apply_mix(empty_docs(tuned)).count() == 0


# 6 repeated bytes ------------------------------------------------------------------------------------


def test_suffix_order_equals_sorting():
    from evigraph.llm.induced import suffix_order

    rng = random.Random(5)
    for trial in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 60))]
        text = np.array([*(text * 5)[:70], 0] if trial % 3 == 0 else [*text, 0], dtype=np.int16)
        own = text.tolist()
        order = sorted(range(len(own)), key=lambda i: own[i:])
        for in_memory, limit in ((1 << 20, 1 << 20), (1, 1 << 20), (1, 3)):  # plain, recursive, with queues on disk
            got, prefix = suffix_order(text, 1000, in_memory, limit)
            assert got.tolist() == order
            for a, b, p in zip(order, order[1:], prefix[1:]):
                assert own[a : a + p] == own[b : b + p] and own[a + p : a + p + 1] != own[b + p : b + p + 1]


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(x, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2_000, 3])
def test_repeats_equal_brute_force(tuned, monkeypatch, hot):
    from evigraph.llm import suffixdup

    monkeypatch.setattr(suffixdup, "HOT_KINDS", hot)
    monkeypatch.setattr(suffixdup, "BLOCK", 1 << 14)
    passage = words(60, 77)
    extra = [(200 + i, words(20, 300 + i) + passage[i % 7 : 320 - i % 5] + words(30, 400 + i), "en", "a", 1) for i in range(25)]
    extra += [(300, "ab" * 400, "en", "a", 1), (301, passage * 3, "en", "a", 1), (302, "x" * 199, "en", "a", 1), (303, "x" * 199, "en", "a", 1), (304, "y" * 201, "en", "a", 1)]
    docs = odd_docs(tuned, extra)
    given = docs.collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(given, plain_repeats([r.text for r in given], 200)))
    got = collections.Counter(tuple(r) for r in suffixdup.repeat_digest(docs).collect())
    assert got == want
    stripped = suffixdup.strip_repeats(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(given)
    assert suffixdup.repeat_digest(empty_docs(tuned)).count() == 0


def test_places_of_a_common_passage_are_not_listed(tuned):
    from evigraph.llm import suffixdup

    passage = words(400, 78)
    docs = tuned.createDataFrame([(i, words(60, 500 + i) + passage) for i in range(30)] + [(i, passage) for i in range(30, 34)], "doc_id long, text string")
    rows = suffixdup.judged_runs(docs).collect()
    # the copies of the passage alone have nothing that occurs once; the others have it only up to where the passage begins
    assert len(rows) == 30
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = suffixdup.without_repeats(docs).collect()
    assert {r.row.doc_id: r.n_removed for r in held if r.row.doc_id >= 30} == dict.fromkeys(range(30, 34), len(passage))
    want = collections.Counter((i, *w[:2]) for i, w in zip(texts, plain_repeats(texts.values(), 200)))
    assert collections.Counter((r.row.doc_id, r.n_bytes, r.n_removed) for r in held) == want
    assert max(start >> 12 for r in rows for start in r.alone) < max(len(t) for t in texts.values()) - len(passage)


# 7 sharding ------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(tuned):
    from evigraph.llm.sharding import schedule, shard

    docs = odd_docs(tuned, [(100 + i, words(5 + i % 200, i % 900), "en", "a", 1) for i in range(1500)])
    rows = shard(docs, 16).collect()
    assert len(rows) == docs.count()
    loads, places, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        if r.doc_id is not None:
            assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
            groups[text[r.doc_id]].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(s) == 1 for s in groups.values())
    rest = sorted(loads.values())[:-1]  # one group is larger than a shard's part
    assert rest[-1] - rest[0] <= 0.02 * rest[-1]
    assert shard(empty_docs(tuned), 16).count() == 0
    # the level rule gives the loads that a heap alone gives
    alone = [0.0] * 4
    for size in [9] * 3 + [5] * 41 + [2] * 30:
        alone[alone.index(min(alone))] += size
    dealt = schedule([(3, 27), (41, 205), (30, 60)], 4)
    loads4 = [sum(n * s for n, s in zip(column, (9, 5, 2))) for column in zip(*dealt)]
    assert sorted(loads4) == sorted(alone)


# 8 Jaccard join --------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [128, 4])
def test_jaccard_join_equals_brute_force(tuned, monkeypatch, tile):
    from evigraph.llm import neardup

    monkeypatch.setattr(neardup, "TILE", tile)
    base = words(120, 50, 5_000).split()
    extra = []
    for i in range(30):
        copy = list(base)
        if i % 3:
            copy[4 * i % 120] = f"changed{i}"
        extra.append((400 + i, " ".join(copy), "en", "a", 1))
    docs = odd_docs(tuned, extra)
    given = docs.collect()
    sets = []
    for r in given:
        w = (r.text or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(given)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = collections.Counter()
    for i in range(len(given)):
        for j in range(i):
            same = (given[i].text or "") == (given[j].text or "")
            union = len(sets[i] | sets[j])
            if same or union and len(sets[i] & sets[j]) / union >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, r in enumerate(given):
        classes[find(i)].append(i)
    name = {c: min((given[i].doc_id for i in members if given[i].doc_id is not None), default=None) for c, members in classes.items()}
    want = collections.Counter((r.doc_id, name[find(i)], links[i]) for i, r in enumerate(given))
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect())
    assert got == want
    kept = neardup.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert neardup.near_duplicates(empty_docs(tuned)).count() == 0


def test_bands_reach_the_recall():
    from evigraph.llm.neardup import bands_for

    bands, rows = bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert 1 - (1 - 0.1**rows) ** bands <= 1e-6
    for threshold in (0.2, 0.5, 1.0):  # the recall holds where unlike texts cannot be kept apart
        bands, rows = bands_for(threshold, 0.99)
        assert bands * rows <= 1024 and 1 - (1 - threshold**rows) ** bands >= 0.99


def test_components_of_stars_chains_and_loops(tuned):
    from evigraph.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.id: r.component for r in components(tuned.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}


# 10 licences -----------------------------------------------------------------------------------------


def test_expressions():
    from evigraph.llm.licences import evaluate, parse_expression

    assert evaluate(parse_expression("MIT OR GPL-3.0-only AND Apache-2.0")) == (True, ["apache-2.0", "gpl-3.0-only", "mit"])
    assert evaluate(parse_expression("(MIT OR GPL-3.0-only) AND LGPL-2.1+ */"))[0] is False
    assert evaluate(parse_expression("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT")) == (True, ["gpl-2.0-only", "mit"])
    for bad in ("", "MIT OR", "(MIT", "MIT)", "MIT GPL-2.0", "OR MIT", "MIT WITH (A OR B)", "MIT & BSD", "()"):
        assert parse_expression(bad) is None


def test_licence_scan_equals_word_search(tuned):
    import re

    from evigraph.llm.licences import BASE, licence_digest, scan_licences

    extra = [
        (500, "Released under the MIT-License, under\nthe mit license; CC BY-NC 4.0. cc by nc", "en", "a", 1),
        (501, "Apache License, Version 2.0 or apache license version 20", "en", "a", 1),
        (502, "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\ntext", "en", "a", 1),
        (503, "SPDX-License-Identifier: MIT OR OR", "en", "a", 1), (504, "cc by éncc by nc", "en", "a", 1),
    ]
    docs = odd_docs(tuned, extra)
    rows = licence_digest(scan_licences(docs)).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        fits = []
        for text in texts[r.doc_id]:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            hits = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in hits]
            fits.append((len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in fits
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    named = {r.doc_id: r.labels for r in rows}
    assert named[502] == "apache-2,gpl-2,mit" and named[503] == "" and named[501] == "apache-2"
    assert scan_licences(empty_docs(tuned)).count() == 0


# the pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(tuned, tmp_path):
    import corpus_pipeline

    docs, labels = quality_corpus(tuned, 80)
    copies = docs.where("doc_id in (0, 2)").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copies).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame, counts = tuned.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(tuned, frame, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        frame = tuned.read.parquet(str(tmp_path / f"out{k}"))
        counts.append(frame.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == set(frame.columns)
    assert counts[0] == 62 and counts[1] == 60 and counts[2] == 60
    assert corpus_pipeline.run(tuned, str(tmp_path)).count() == counts[-1]


def test_long_text_of_phrases_is_scanned_in_linear_time(tuned):
    import time

    from evigraph.llm.licences import licence_digest, scan_licences

    n = 400_000
    docs = tuned.createDataFrame([(1, "x " + "cc by nc " * n)], "doc_id long, text string")
    begun = time.time()
    r = licence_digest(scan_licences(docs)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (3 * n + 1, n, 1, 3 * n - 2)
    assert time.time() - begun < 60


def test_pieces_that_cannot_fill_a_sequence_are_still_packed_together(tuned):
    from evigraph.llm.packing import pack

    rng = random.Random(3)
    pieces = [(i, 0, 0, 60 if i % 3 else rng.randrange(1, 40), 0) for i in range(3000)]
    rows = pack(tuned.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"), 100, 300).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 100
    # no sequence holds two of the 2,000 large pieces; the small ones fit beside them
    assert len(places) == 2000


def test_frames_made_before_others_still_see_small_batches(tuned):
    import pyarrow as pa

    from evigraph.llm.common import map_arrow

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = tuned.range(5000)
    before = tuned.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, second = map_arrow(rows, sizes, "n long", 3), map_arrow(rows, sizes, "n long", 100)
    assert max(r.n for r in first.collect()) == 3 and max(r.n for r in second.collect()) == 100
    assert tuned.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
