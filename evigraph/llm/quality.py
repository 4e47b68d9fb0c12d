"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow, text_key

# Labelled rows the model is fitted on, and lines that these may have together: 132 bytes a line reach the
# driver, 66 MB at most. Training texts are whole, and scoring has no such bounds.
TRAIN_ROWS = 6_000
TRAIN_LINES = 500_000
THRESHOLD = 0.7
# Bytes whose features are computed together; the counts of a longer line are added up over such parts.
BLOCK = 1 << 20
PART = 1 << 18

# Byte classes: 0 other, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 space, 5 sentence mark, 6 symbol
CLASSES = np.zeros(256, dtype=np.int64)
CLASSES[ord("a") : ord("z") + 1] = 1
CLASSES[128:] = 1
CLASSES[ord("A") : ord("Z") + 1] = 2
CLASSES[ord("0") : ord("9") + 1] = 3
CLASSES[[9, 11, 12, 13, 32]] = 4
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 5
CLASSES[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
N_CLASSES = 7
N_OWN = 10
N_FEATURES = 3 * N_OWN + 3
_mix = np.random.default_rng(11).integers(1, 1 << 62, size=(256,), dtype=np.int64).astype(np.uint64)
_powers = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))


# Columns of a line's counts: its byte classes, then words, repeated words, words with symbols and bytes.
WORDS, AGAIN, MARKED, SIZE = range(N_CLASSES, N_CLASSES + 4)


class _LineCounter:
    """Counts of one line whose bytes come in parts; a word may go over the end of a part."""

    def __init__(self):
        self.counts = np.zeros(SIZE + 1)
        self.last = None  # code of the last whole word
        self.at, self.code, self.symbol = 0, np.uint64(0), False  # the word at the end of the last part

    def add(self, data: np.ndarray) -> None:
        kinds = CLASSES[data]
        self.counts[:N_CLASSES] += np.bincount(kinds, minlength=N_CLASSES)
        self.counts[SIZE] += len(data)
        inside = kinds != 4
        if self.at and not inside[0]:
            self.close()
        begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if not len(begins):
            return
        at = np.arange(len(data)) - np.repeat(np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(data)]))))
        if self.at:  # the first word goes on
            at[: begins[1] if len(begins) > 1 else len(data)] += self.at
        value = np.where(inside, _mix[data] * _powers[at & 255], np.uint64(0))
        code = np.add.reduceat(value, begins)
        symbol = np.add.reduceat((kinds == 6).astype(np.int64), begins) > 0
        if self.at:
            code[:1] += self.code
            symbol[0] |= self.symbol
        self.at = 0
        if inside[-1]:
            self.at, self.code, self.symbol = int(at[-1]) + 1, code[-1], bool(symbol[-1])
            code, symbol = code[:-1], symbol[:-1]
        if len(code):
            self.counts[WORDS] += len(code)
            self.counts[MARKED] += symbol.sum()
            self.counts[AGAIN] += (code[1:] == code[:-1]).sum() + (self.last is not None and self.last == code[0])
            self.last = code[-1]

    def close(self) -> None:
        """End the word that reached the end of the last part."""
        if self.at:
            self.counts[WORDS] += 1
            self.counts[MARKED] += self.symbol
            self.counts[AGAIN] += self.last is not None and self.last == self.code
            self.last, self.at = self.code, 0


def _counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of lines that lie in ``data`` one after another, each ended by a new-line byte."""
    n = len(starts)
    line = np.repeat(np.arange(n), ends - starts + 1)
    kinds = CLASSES[data]
    kinds[ends] = 4
    out = np.zeros((n, SIZE + 1))
    out[:, :N_CLASSES] = np.bincount(line * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, 4] -= 1
    out[:, SIZE] = ends - starts
    inside = kinds != 4
    begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if len(begins):
        at = np.arange(len(data)) - np.repeat(np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(data)]))))
        value = np.where(inside, _mix[data] * _powers[at & 255], np.uint64(0))
        code = np.add.reduceat(value, begins)
        symbols = np.add.reduceat((kinds == 6).astype(np.int64), begins)
        of = line[begins]
        out[:, WORDS] = np.bincount(of, minlength=n)
        same = np.concatenate(([False], (code[1:] == code[:-1]) & (of[1:] == of[:-1])))
        out[:, AGAIN] = np.bincount(of[same], minlength=n)
        out[:, MARKED] = np.bincount(of[symbols > 0], minlength=n)
    return out


def _own_features(counts: np.ndarray) -> np.ndarray:
    """Features of lines from their counts."""
    size = np.maximum(counts[:, SIZE], 1)
    words = counts[:, WORDS]
    count = np.maximum(words, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    return np.stack(
        [
            counts[:, 2] / letters,
            counts[:, 3] / size,
            counts[:, 5] / size,
            np.minimum(counts[:, 6] / size * 5, 1),
            counts[:, AGAIN] / count,
            counts[:, MARKED] / count,
            np.minimum(letters / count / 20, 1),
            np.log1p(size) / 12,
            np.minimum(counts[:, 2] / count, 1),
            (words == 0).astype(np.float64),
        ],
        axis=1,
    )


def _long_text(text: bytes) -> Iterator[np.ndarray]:
    """Counts of the lines of a long text, some lines or one long line at a time."""
    i = 0
    while i <= len(text):
        j = len(text) if len(text) - i <= PART else text.rfind(b"\n", i, i + PART)
        if j >= i:
            raw = np.frombuffer(text[i:j] + b"\n", dtype=np.uint8)
            ends = np.flatnonzero(raw == 10)
            yield _counts(raw, np.concatenate(([0], ends[:-1] + 1)), ends)
        else:
            j = text.find(b"\n", i)
            j = len(text) if j < 0 else j
            line = _LineCounter()
            for at in range(i, j, PART):
                line.add(np.frombuffer(text, dtype=np.uint8, count=min(PART, j - at), offset=at))
            line.close()
            yield line.counts[None]
        i = j + 1


def _with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, flags of the ends and a constant."""
    before = np.concatenate((np.zeros((1, N_OWN)), own[:-1]))
    after = np.concatenate((own[1:], np.zeros((1, N_OWN))))
    before[first] = 0
    after[last] = 0
    return np.concatenate((own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))), axis=1)


def line_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, lengths and document numbers (counted on) of the lines of blocks of whole documents."""
    number, at = 0, 0
    while at < len(texts):
        begin, size = at, 0
        while at < len(texts) and (at == begin or size + len(texts[at]) < BLOCK):
            size += len(texts[at]) + 1
            at += 1
        group = texts[begin:at]
        if size <= BLOCK:
            raw = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
            ends = np.flatnonzero(raw == 10)
            starts = np.concatenate(([0], ends[:-1] + 1))
            counts = _counts(raw, starts, ends)
            stops = np.cumsum(np.array([len(t) for t in group]) + 1)
            owner = number + np.searchsorted(stops, starts, side="right")
        else:  # one long document, described in parts so that no array grows with its bytes
            counts = np.concatenate(list(_long_text(group[0])))
            owner = np.full(len(counts), number)
        own, lengths = _own_features(counts), counts[:, SIZE].astype(np.int64)
        change = owner[1:] != owner[:-1]
        first, last = np.concatenate(([True], change)), np.concatenate((change, [True]))
        yield _with_neighbours(own, first, last), lengths, owner
        number += len(group)


def _chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return first, np.diff(np.concatenate((first, [len(owner)])))


def marginals(scores: np.ndarray, move: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(bad) of every line and the expected moves between states, all chains at once.

    ``scores``: log-odds of bad per line; ``move``: 2 x 2 log-weights from one line's state to the next.
    """
    first, length = _chains(owner)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n = len(scores)
    emit = np.stack((np.zeros(n), scores), axis=1)
    ahead, back = np.empty((n, 2)), np.zeros((n, 2))
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    ahead[first] = emit[first]
    for t in range(1, length[0]):
        now = first[: active[t]] + t
        ahead[now] = emit[now] + np.logaddexp(ahead[now - 1, 0, None] + move[0], ahead[now - 1, 1, None] + move[1])
        ahead[now] -= ahead[now].max(axis=1, keepdims=True)
    for t in range(length[0] - 1, 0, -1):
        now = first[: active[t]] + t
        onward = emit[now] + back[now]
        back[now - 1] = np.logaddexp(onward[:, 0, None] + move[:, 0], onward[:, 1, None] + move[:, 1])
        back[now - 1] -= back[now - 1].max(axis=1, keepdims=True)
    both = ahead + back
    bad = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    pair = ahead[follows - 1][:, :, None] + move[None] + (emit[follows] + back[follows])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return bad, pair.sum(axis=0)


def _adam(params: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        g = gradient(params)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params


def fit_field(x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Line weights and moves of the field by gradient ascent on the conditional likelihood of ``y``."""
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    seen = np.bincount(2 * y[follows - 1].astype(int) + y[follows].astype(int), minlength=4).reshape(2, 2)
    n = len(y)

    def gradient(p):
        w, move = p[:-4], p[-4:].reshape(2, 2)
        bad, pairs = marginals(x @ w, move, owner)
        return np.concatenate((x.T @ (bad - y) / n, (pairs - seen).ravel() / n)) + penalty * p

    p = _adam(np.zeros(x.shape[1] + 4), gradient, steps, 0.1)
    return p[:-4], p[-4:].reshape(2, 2)


def _document_inputs(bad: np.ndarray, length: np.ndarray, owner: np.ndarray, base: int, count: int) -> np.ndarray:
    """Length-weighted bad part, bad bytes (log) and a constant per document."""
    weight = length + 1.0
    mass = np.bincount(owner - base, weights=bad * weight, minlength=count)
    total = np.bincount(owner - base, weights=weight, minlength=count)
    return np.stack((mass / np.maximum(total, 1), np.log1p(mass) / 5, np.ones(count)), axis=1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> tuple | None:
    """Fit the field on at most ``rows`` labelled documents of at most ``lines`` lines together.

    Rows are taken in the order of a hash of their id; one with more lines than are left is passed over.
    Equal rows count once; of contradicting labels each counts. A line starts with the label of its
    document; then lines of bad documents that the field finds good are taken as good and the field is
    fitted again. At last a logistic curve turns the length-weighted marginals into the probability of
    label 1. None without any labelled row; with labels of one kind the scores lean to it.
    """
    known = (
        labels.select(F.col("doc_id").alias("label_id"), "quality")
        .where("quality in (0, 1) and label_id is not null")
        .distinct()
        .orderBy(F.md5(F.col("label_id").cast("string")), "label_id", "quality")
        .limit(rows)
    )
    keys = ["label_id", "quality", "k1", "k2"]
    text = F.coalesce("text", F.lit(""))
    # at most ``rows`` pairs of numbers are broadcast
    labelled = docs.select("doc_id", "text", *text_key("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    sized = labelled.select(*keys, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines")).distinct()
    chosen, left = [], lines
    for r in sized.orderBy(F.md5(F.col("label_id").cast("string")), *keys).limit(rows).collect():
        if r.lines <= left:
            chosen.append(tuple(r[k] for k in keys))
            left -= r.lines
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame(chosen, labelled.select(*keys).schema)
    whole = labelled.join(F.broadcast(picked), keys).select(*keys, "text").dropDuplicates(keys).select("text", "quality")

    def describe(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0).cast(pa.large_binary())]
            features, lengths = [], []
            for x, length, owner in line_features(texts):
                first, count = _chains(owner)
                for f, c in zip(first, count, strict=True):
                    features.append(x[f : f + c].astype("<f4").tobytes())
                    lengths.append(length[f : f + c].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array(lengths, pa.list_(pa.int64())), batch.column(1)], ["x", "length", "quality"])

    sample = map_arrow(whole, describe, "x binary, length array<long>, quality int").toPandas()
    sample = sample.sort_values(["quality", "x"])  # so that reruns fit on the same order
    x = np.concatenate([np.frombuffer(b, dtype="<f4").reshape(-1, N_FEATURES) for b in sample.x]).astype(np.float64)
    length = np.concatenate(sample.length.to_list())
    owner = np.repeat(np.arange(len(sample)), [len(v) for v in sample.length])
    poor = sample.quality.to_numpy() == 0
    y = poor[owner].astype(np.float64)
    w, move = fit_field(x, owner, y)
    for _ in range(2):
        bad, _ = marginals(x @ w, move, owner)
        keep = poor[owner] & (bad >= 0.5)
        # a bad document has at least its worst line
        worst = np.zeros(len(sample))
        np.maximum.at(worst, owner, bad)
        y = (keep | poor[owner] & (bad >= worst[owner])).astype(np.float64)
        w, move = fit_field(x, owner, y)
    bad, _ = marginals(x @ w, move, owner)
    z = _document_inputs(bad, length, owner, 0, len(sample))
    good = 1 - poor.astype(np.float64)
    curve = _adam(np.zeros(3), lambda c: z.T @ (1 / (1 + np.exp(-z @ c)) - good) / len(z) + 1e-4 * c * [1, 1, 0], 600, 0.1)
    return w, move, curve


def score_documents(docs: DataFrame, model: tuple | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, ``bad_bytes`` of every whole text.

    A null text counts as empty: one empty line. Without a model the score is 1, as nothing speaks
    against any document. Equal texts score alike. Documents are scored where they are read.
    """
    keep = keep or ["doc_id"]
    fields = docs.select(*keep).schema

    def score(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(batch.num_columns - 1).cast(pa.large_binary())]
            out, mass = np.ones(len(texts)), np.zeros(len(texts))
            if model is not None:
                w, move, curve = model
                for x, length, owner in line_features(texts):
                    bad, _ = marginals(x @ w, move, owner)
                    base, count = owner[0], owner[-1] - owner[0] + 1
                    z = _document_inputs(bad, length, owner, base, count)
                    out[base : base + count] = 1 / (1 + np.exp(-z @ curve))
                    mass[base : base + count] = np.bincount(owner - base, weights=bad * length, minlength=count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out), pa.array(mass)], [*batch.schema.names[:-1], "_score", "_bad_bytes"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = map_arrow(docs.select(*keep, F.col("text").alias("_text")), score, f"{schema}, _score double, _bad_bytes double")
    return scored.withColumnsRenamed({"_score": "score", "_bad_bytes": "bad_bytes"})


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, bad_bytes`` of every document.

    Only labels of rows that are not held out are read; a document's score depends on its text alone.
    ``predicted`` is 1 from ``THRESHOLD`` on. Null ids are not held out. Rows with equal ``doc_id`` are
    separate documents. Other columns are ignored.
    """
    model = train(docs, labels.where(~F.coalesce(held_out("doc_id"), F.lit(False))), rows)
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "bad_bytes",
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    names = docs.columns
    model = train(docs, labels.where(~F.coalesce(held_out("doc_id"), F.lit(False))), rows)
    scored = score_documents(docs, model, names)
    # the score stands last; a column of that name in ``docs`` stays as it is
    return scored.toDF(*names, "_quality", "_mass").where(F.col("_quality") >= THRESHOLD).select(*names)
