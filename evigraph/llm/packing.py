"""Packing documents into fixed-length sequences with swap-based local search."""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow, written
from evigraph.llm.tokens import default_tokenizer, encode_texts, forget

END = 1
# Pieces packed together in one task, and the fill below which a sequence is packed again with others.
BLOCK = 40_000
LEAST_FILL = 0.995
# By how much that fill falls after a round that settled less than half of its pieces.
FILL_STEP = 0.1
# Local search: underfull bins looked at for a piece, and bins in a row that may fail to empty.
VISITED = 64
PATIENCE = 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, length: int, path: str) -> DataFrame:
    """Ids of every document and the end id, cut every ``length`` ids."""
    end = np.array([END], dtype="<u4").tobytes()

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1), path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        forget()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


class Bins:
    """Bins of one block, found by their free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []  # sizes' positions
        self.free: list[int] = []
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0

    def index(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].add(b)
        self.mask |= 1 << f

    def unindex(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].discard(b)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)

    def tightest(self, size: int, least: int = 0) -> int:
        """The smallest free space of ``size`` or more, -1 if there is none."""
        above = self.mask >> max(size, least)
        return max(size, least) + (above & -above).bit_length() - 1 if above else -1

    def put(self, b: int, i: int, size: int) -> None:
        self.unindex(b)
        self.items[b].append(i)
        self.free[b] -= size
        self.index(b)

    def take(self, b: int, i: int, size: int) -> None:
        self.unindex(b)
        self.items[b].remove(i)
        self.free[b] += size
        self.index(b)


def best_fit(sizes: list[int], capacity: int) -> Bins:
    """Best fit from the largest piece down."""
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        f = bins.tightest(sizes[i])
        if f < 0:
            bins.items.append([])
            bins.free.append(capacity)
            b = len(bins.items) - 1
            bins.index(b)
        else:
            b = min(bins.by_free[f])
        bins.put(b, i, sizes[i])
    return bins


def improve(bins: Bins, sizes: list[int]) -> None:
    """Local search: raise the sum of squared fills until a bin is empty, then go on with the next.

    The emptiest bin gives to fuller underfull bins, those with most room first: a piece moves, is
    exchanged for a smaller one, or is exchanged for two that are smaller together. Each step makes
    the fuller bin fuller, so the sum of squares rises and the search ends. A bin that cannot give is
    passed over, after ``PATIENCE`` of them in a row nothing more is tried. The search also ends when
    the bins are as few as the total size allows.
    """
    least = -(-sum(sizes) // bins.capacity)
    used = sum(1 for x in bins.items if x)
    stuck: set[int] = set()
    while used > least and len(stuck) < PATIENCE:
        open_bins = [b for b in range(len(bins.items)) if bins.items[b] and bins.free[b]]
        donors = [b for b in open_bins if b not in stuck]
        if not donors:
            return
        a = max(donors, key=lambda b: bins.free[b])
        gave = 0
        for _ in range(PATIENCE):
            others = heapq.nlargest(VISITED, (b for b in open_bins if b != a and 0 < bins.free[b] <= bins.free[a]), key=lambda b: bins.free[b])
            gave_now = sum(_give(bins, sizes, a, i, others) for i in sorted(bins.items[a], key=lambda i: -sizes[i]))
            gave += gave_now
            if not gave_now or not bins.items[a]:
                break
        if gave:  # bins that could not give before may now
            stuck.clear()
        if bins.items[a]:
            stuck.add(a)
        else:
            used -= 1


def _give(bins: Bins, sizes: list[int], a: int, i: int, others: list[int]) -> bool:
    x = sizes[i]
    for b in others:
        room = bins.free[b]
        if room == 0:
            continue
        if room >= x:
            swap = ()
        else:
            own = sorted(bins.items[b], key=lambda j: sizes[j])
            values = [sizes[j] for j in own]
            k = bisect.bisect_left(values, x - room)
            best, swap = (x - values[k], (own[k],)) if k < len(values) and values[k] < x else (0, None)
            for m, y in enumerate(values):
                k = max(bisect.bisect_left(values, x - room - y), m + 1)
                if k < len(values) and best < x - y - values[k] <= room:
                    best, swap = x - y - values[k], (own[m], own[k])
            if swap is None:
                continue
        bins.take(a, i, x)
        for j in swap:
            bins.take(b, j, sizes[j])
            bins.put(a, j, sizes[j])
        bins.put(b, i, x)
        return True
    return False


def pack(pieces: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Give every piece a sequence and a place in it: ``sequence_id`` and ``offset`` are added.

    Pieces are spread evenly over tasks of about ``block`` pieces, each packed by best fit and local
    search. Sequences that stay below ``LEAST_FILL`` are opened again and packed with those of the
    other tasks, in fewer and fewer tasks; the rows of a round are a small part of those before. Where
    most of a round stay below it (pieces that cannot fill a sequence), the next rounds ask for a tenth
    less each, so there are at most ten such rounds.
    """
    whole = pieces.where(F.col("length") == length).select(
        "*", F.shiftleft(F.monotonically_increasing_id(), 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    names = pieces.columns
    rest, done, turn = pieces.where(F.col("length") < length), [whole], 0
    count, least = rest.count(), LEAST_FILL
    while count:
        tasks = -(-count // block)
        packed = written(_round(rest.repartition(tasks), length, turn, 0.0 if tasks == 1 else least))
        done.append(packed.where("settled").drop("settled"))
        rest = packed.where("not settled").select(*names)
        before, count = count, 0 if tasks == 1 else rest.count()
        if count > before // 2:  # most sequences cannot be filled so far: ask for less from here on
            least -= FILL_STEP
        turn += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _round(rest: DataFrame, length: int, turn: int, least: float) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        held = pa.Table.from_batches(rows).combine_chunks()
        sizes = held.column("length").to_pylist()
        bins = best_fit(sizes, length)
        improve(bins, sizes)
        base = (turn << 48 | TaskContext.get().partitionId() << 24) << 1 | 1
        order, sequence, offset, settled = [], [], [], []
        for b, items in enumerate(bins.items):
            at, full = 0, length - bins.free[b] >= least * length
            for i in items:
                order.append(i)
                sequence.append(base + (b << 1))
                offset.append(at)
                settled.append(full)
                at += sizes[i]
        out = held.take(pa.array(order, pa.int64()))
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("settled", settled, pa.bool_())):
            out = out.append_column(name, pa.array(values, kind))
        yield from out.to_batches()

    return map_arrow(rest, run, PIECES + ", sequence_id long, offset long, settled boolean", 10_000)


def pack_documents(docs: DataFrame, length: int = 4096, path: str | None = None) -> DataFrame:
    """All documents in as few sequences of at most ``length`` tokens as the search finds.

    Result, one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null
    or empty text is one piece that holds the end id alone. Only documents longer than a sequence are
    cut. Rows with equal ``doc_id`` are separate documents. Other columns are ignored; an empty table
    gives no rows. Texts are tokenised where they are read; only piece sizes are shuffled.
    """
    return pack(written(token_pieces(docs, length, path or default_tokenizer())), length)
