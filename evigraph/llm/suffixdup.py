"""Removal of repeated byte strings by suffix sorting of the places where a repeat can be."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow, scalars, text_key, width, written
from evigraph.llm.induced import repeated_starts

LENGTH = 200
# Length of the anchors, and bytes whose anchors are computed together.
ANCHOR = 48
BLOCK = 1 << 18
# Bytes of text that are suffix-sorted together; a group with one anchor is never divided.
SHARD_BYTES = 2 << 20
# An anchor with more different chunks than this (and more than this part of all chunks) is hot: its
# runs are divided into slices of SLICE starts, each with a key of its own.
HOT_KINDS = 2_000
HOT_PART = 100_000
SLICE = 16

_BASE = 0x9E3779B97F4A7C15
_state: dict = {}


def _constants() -> dict:
    if not _state:
        span = 2 * BLOCK + 4 * LENGTH
        rng = np.random.default_rng(31)
        _state["symbol"] = rng.integers(1, 1 << 63, size=256).astype(np.uint64)
        factors = np.ones(span + 1, dtype=np.uint64)
        factors[1:] = _BASE
        _state["power"] = np.cumprod(factors)
        factors[1:] = pow(_BASE, -1, 1 << 64)
        _state["inverse"] = np.cumprod(factors)
    return _state


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Runs of successive starts whose ``length``-byte strings have the same anchor.

    The anchor of a string is its ANCHOR-byte part with the smallest hash (the first on ties). Equal
    strings have equal anchors at equal places, so a string can only be repeated under the same anchor.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int):
        """``data``: documents one after another; ``begins``, ``ends``: theirs, each ``length`` bytes at least."""
        k = _constants()
        n = len(data)
        self.length = length
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(k["symbol"][data] * k["power"][:n], out=self.sums[1:])
        grams = _mix(self._hash(np.arange(n - ANCHOR + 1), ANCHOR))
        low = np.uint64((1 << 24) - 1)
        least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        size, wide = 1, length - ANCHOR + 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if wide > size:
            least = np.minimum(least[: size - wide], least[wide - size :])
        breaks = np.empty(len(least) + 1, dtype=bool)
        breaks[0] = True
        breaks[1:-1] = least[1:] != least[:-1]
        breaks[-1] = True
        breaks[begins] = True
        breaks[ends - length + 1] = True
        first = np.flatnonzero(breaks)
        first, last = first[:-1], first[1:] - 1
        document = np.searchsorted(begins, first, side="right") - 1
        valid = last <= ends[document] - length
        self.document, self.first, self.last = document[valid], first[valid], last[valid]
        self.place = (least[self.first] & low).astype(np.int64)
        self.anchor = grams[self.place].view(np.int64)
        self.chunk = self.hash_of(self.first, self.last - self.first + length)

    def _hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _constants()["inverse"][at]

    def hash_of(self, at: np.ndarray, size) -> np.ndarray:
        return _mix(self._hash(at, size)).view(np.int64)

    def divide(self, hot: np.ndarray) -> None:
        """Keep the runs of the hot anchors (sorted) only, cut into slices with keys of their own.

        Slice j has the starts at distances of j * SLICE up to (j + 1) * SLICE - 1 before the anchor. All
        strings that start there contain the slice's core, so equal strings are in slices with equal
        cores, and what may differ under one key are the few bytes before and after a core.
        """
        spot = np.searchsorted(hot, self.anchor)
        is_hot = np.zeros(len(self.anchor), dtype=bool)
        inside = spot < len(hot)
        is_hot[inside] = hot[spot[inside]] == self.anchor[inside]
        runs = np.flatnonzero(is_hot)
        near = (self.place[runs] - self.last[runs]) // SLICE
        far = (self.place[runs] - self.first[runs]) // SLICE
        count = far - near + 1
        run = np.repeat(runs, count)
        j = np.repeat(near, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = self.place[run]
        core_at, core_end = place - j * SLICE, place - (j + 1) * SLICE + 1 + self.length
        first = np.maximum(self.first[run], place - (j + 1) * SLICE + 1)
        last = np.minimum(self.last[run], place - j * SLICE)
        core = self.hash_of(core_at, core_end - core_at).view(np.uint64)
        anchor = _mix(self.anchor[run].view(np.uint64) + core * np.uint64(_BASE) + j.astype(np.uint64)).view(np.int64)
        self.chunk = self.hash_of(first, last - first + self.length)
        self.anchor, self.document, self.place = anchor, self.document[run], place
        self.first, self.last = first, last


def _blocks(texts: list[bytes], length: int):
    """Data, begins, ends, document numbers and offsets within them, in blocks of bounded size."""
    held, size = [], 0

    def block():
        data = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8)
        sizes = np.array([len(t) for _, _, t in held])
        ends = np.cumsum(sizes)
        return data, ends - sizes, ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])

    for i, text in enumerate(texts):
        # a long text goes in parts that share length - 1 bytes, so that every start is in one part
        for at in range(0, len(text) - length + 1, BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                yield block()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield block()


def _run_rows(docs: DataFrame, length: int, hot: list[int] | None = None) -> DataFrame:
    """``anchor, chunk, k1, k2, at, more`` of every run; slices of hot anchors if given."""
    hot_anchors = None if hot is None else np.sort(np.array(hot, dtype=np.int64))

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0).cast(pa.large_binary())]
            keys = [batch.column(c).to_numpy() for c in (1, 2)]
            for data, begins, ends, numbers, offsets in _blocks(texts, length):
                runs = Runs(data, begins, ends, length)
                if hot_anchors is not None:
                    runs.divide(hot_anchors)
                of = numbers[runs.document]
                at = runs.first - begins[runs.document] + offsets[runs.document]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (runs.anchor, runs.chunk, keys[0][of], keys[1][of], at, runs.last - runs.first)],
                    ["anchor", "chunk", "k1", "k2", "at", "more"],
                )

    return map_arrow(docs.select("text", *text_key("text")), run, "anchor long, chunk long, k1 long, k2 long, at long, more long", 500)


def _counted(runs: DataFrame, *keys: str) -> DataFrame:
    """``n`` runs per key and the place of one of them."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "more")).alias("one"))


def _open(chunks: DataFrame) -> DataFrame:
    """Anchors with a chunk that occurs once and others beside it."""
    return chunks.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")


def _split_hot(docs: DataFrame, chunks: DataFrame, length: int) -> DataFrame:
    """The chunks with those of hot anchors divided into slices."""
    total = scalars(chunks, F.count(F.lit(1)))[0]
    # at most HOT_PART anchors can have more than total / HOT_PART chunks, so their number is bounded
    hot = [r.anchor for r in _open(chunks).where(F.col("kinds") > max(HOT_KINDS, total // HOT_PART)).select("anchor").collect()]
    if not hot:
        return chunks
    listed = F.broadcast(docs.sparkSession.createDataFrame([(a,) for a in hot], "anchor long"))
    return chunks.join(listed, "anchor", "left_anti").unionByName(written(_counted(_run_rows(docs, length, hot), "anchor", "chunk")))


def judged_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1, k2, alone, found``: per distinct text the runs whose chunk occurs once and, within them, the starts of
    repeated strings, both as packed (start, more). All other starts of a text are repeats.

    1. Every start is given the anchor of its string; anchors are counted. A string whose anchor occurs
       once in the corpus is unique, so only runs under repeated anchors go on.
    2. Equal chunks (a run's starts and the bytes of their strings) collapse to one with its count before
       the shuffle; a chunk that occurs twice is a repeat as a whole. Its places need no list, as the runs
       divide a text: they are what the chunks that occur once leave over. So a passage in very many texts
       makes one row however often it occurs.
    3. Chunks that occur once beside others under their anchor are suffix-sorted with these: shards of
       whole anchors, sorted by external induction; neighbours that share ``length`` bytes are repeats.
    """
    spark = docs.sparkSession
    counts = written(_counted(_run_rows(docs, length), "anchor"))
    met = _run_rows(docs, length).join(counts.where("n > 1").select("anchor"), "anchor")
    chunks = _split_hot(docs, written(_counted(met, "anchor", "chunk")), length)
    open_ = _open(chunks)
    sorted_ = chunks.join(open_.select("anchor"), "anchor").select("one.*", "anchor", "chunk", (F.col("n") == 1).alias("asked"))
    pieces = sorted_.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "more", "anchor", "chunk", "asked")).alias("pieces"))
    holders = docs.select(*text_key("text"), F.col("doc_id").cast("long").alias("holder"), "text")
    first = docs.select(*text_key("text"), F.col("doc_id").cast("long").alias("holder")).groupBy("k1", "k2").agg(F.min("holder").alias("first_id"))
    # one row of each text is cut; rows that repeat its id as well give pieces that the task drops
    wanted = written(pieces.join(first, ["k1", "k2"]))
    texts = holders.join(wanted, ["k1", "k2"]).where(F.col("holder").eqNullSafe(F.col("first_id")))

    def cut(batches):
        for batch in batches:
            rows = []
            for k1, k2, text, held in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                rows.extend((p["anchor"], p["chunk"], k1, k2, p["at"], p["asked"], text[p["at"] : p["at"] + p["more"] + length]) for p in held)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "chunk", "k1", "k2", "at", "asked", "bytes"]
            )

    cut_schema = "anchor long, chunk long, k1 long, k2 long, at long, asked boolean, bytes binary"
    given = map_arrow(texts.select("k1", "k2", F.col("text").cast("binary"), "pieces"), cut, cut_schema, 200)
    dealt = given.repartition(width(spark), "anchor").sortWithinPartitions("anchor", "chunk")

    def sort(batches):
        def solve(shard):
            found = repeated_starts([row[6] for row in shard], length)
            k1s, k2s, spans = [], [], []
            for row, starts in zip(shard, found, strict=True):
                if row[5] and len(starts):
                    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
                    for part in np.split(starts, breaks):
                        k1s.append(row[2])
                        k2s.append(row[3])
                        spans.append((row[4] + int(part[0])) << 12 | len(part) - 1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k1s, k2s, spans)], ["k1", "k2", "span"])

        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and row[:2] == last[:2]:
                    continue  # the same chunk from a repeated row
                if size >= SHARD_BYTES and row[0] != last[0]:
                    yield solve(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row[6])
                last = row
        if shard:
            yield solve(shard)

    single = written(map_arrow(dealt, sort, "k1 long, k2 long, span long", 2000))
    packed = F.shiftleft("one.at", 12).bitwiseOR(F.col("one.more"))
    once = [t.where("n = 1").select("one.k1", "one.k2", packed.alias("span"), F.lit(True).alias("run")) for t in (counts, chunks)]
    every = once[0].unionByName(once[1]).unionByName(single.withColumn("run", F.lit(False)))
    span = lambda run: F.collect_set(F.when(F.col("run") == run, F.col("span")))  # noqa: E731  a text's own
    return written(every.groupBy("k1", "k2").agg(span(True).alias("alone"), span(False).alias("found")))


def _removed(size: int, alone: list[int] | None, found: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed runs of a text."""
    starts = size - length + 1
    if starts <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    unique = np.sort(np.array(alone or [], dtype=np.int64))
    # what lies between the runs that occur once
    first = np.concatenate(([0], (unique >> 12) + (unique & 4095) + 1))
    after = np.concatenate((unique >> 12, [starts]))
    gap = after > first
    packed = np.array(found or [], dtype=np.int64)
    begin = np.concatenate((first[gap], packed >> 12))
    end = np.concatenate((after[gap] - 1, (packed >> 12) + (packed & 4095))) + length
    if not len(begin):
        return begin, end
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    last = np.concatenate((new[1:], [True]))
    return begin[new], end[last]


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``n_bytes, n_removed, removed`` (list of begin, end) and ``kept`` (bytes left).

    Texts are UTF-8 bytes, null is empty. Every byte covered by a ``length``-byte string that also starts
    anywhere else in the corpus, the same document included, is removed; overlaps count, matches never
    cross documents, and strings are judged on the input. Equal texts of ``length`` bytes or more lose all
    bytes, shorter texts none. Rows with equal ``doc_id`` are separate documents.
    """
    keep = keep or ["doc_id"]
    judged = judged_runs(docs, length)
    fields = docs.select(*keep).schema
    rows = docs.select(F.struct(*keep).alias("row"), *text_key("text"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(judged, ["k1", "k2"], "left").select("row", "text", "alone", "found")

    def remove(batches):
        for batch in batches:
            sizes, removed, lists, kept = [], [], [], []
            for text, alone, found in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                text = text or b""
                begins, ends = _removed(len(text), alone, found, length)
                left, at = [], 0
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                sizes.append(len(text))
                removed.append(int((ends - begins).sum()))
                lists.append([{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
                kept.append(b"".join(left))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, span), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "n_removed", "removed", "kept"],
            )

    schema = f"row {fields.simpleString()}, n_bytes long, n_removed long, removed array<struct<begin: bigint, end: bigint>>, kept binary"
    return map_arrow(joined, remove, schema, 500)


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return without_repeats(docs.select("doc_id", "text"), length).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with repeated strings taken out of ``text``; ``n_chars`` follows the text.

    A removal may begin or end inside a character; what is left of such a character goes as well. A
    null text stays null.
    """
    names = docs.columns
    left = without_repeats(docs, length, names)

    def decode(batches):
        for batch in batches:
            texts = [None if raw is None else raw.decode("utf-8", "ignore") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    shown = left.select("row", F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("kept"))
    text = map_arrow(shown, decode, f"row {docs.schema.simpleString()}, text string", 500)
    return text.select(*[
        F.col("text").alias(c) if c == "text" else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
        for c in names
    ])
