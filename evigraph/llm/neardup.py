"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow, text_key, width, written
from evigraph.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
# Two texts that share a tenth of their n-grams may meet once in a million cases, so that chance
# meetings do not connect a large corpus into one group.
UNLIKE = 0.1
CHANCE = 1e-6
HASHES = 1024
# Texts, and bytes of text, that meet each other in one task at most (twice that for two tiles).
TILE = 128
TILE_BYTES = 8 << 20
COLUMNS = 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, unlike: float = UNLIKE, chance: float = CHANCE) -> tuple[int, int]:
    """Bands and rows that fit together: the fewest rows that keep unlike texts apart, the bands that give the recall.

    A pair at ``threshold`` shares a band with probability ``recall`` or more, a pair of similarity
    ``unlike`` with probability ``chance`` or less. Where ``HASHES`` minima do not reach that (a
    threshold near ``unlike``), the most rows within them are taken; the recall holds all the same.
    """
    best = None
    for rows in range(1, HASHES + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(threshold, 1 - 1e-12) ** rows)))
        if best and bands * rows > HASHES:
            break
        best = bands, rows
        if 1 - (1 - unlike**rows) ** bands <= chance:
            break
    return best


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of every text and where each text's begin (one more at the end).

    A word is a run without ASCII white space. A text of fewer words has one n-gram, the whole of it;
    one without words has none. Repeated n-grams are repeated.
    """
    import xxhash

    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pieces.flatten()
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    if pc.any(pc.equal(pc.utf8_length(flat), 0)).as_py():  # what stands before leading or after trailing space
        real = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        flat, offsets = flat.filter(real), kept[offsets]
    coded = pc.dictionary_encode(flat)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    value = hashes[coded.indices.to_numpy()] if len(flat) else np.empty(0, dtype=np.uint64)
    count = np.diff(offsets)
    grams = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begins = np.concatenate(([0], np.cumsum(grams)))
    padded = np.concatenate((value, np.zeros(words, dtype=np.uint64)))
    at = np.repeat(offsets[:-1] - begins[:-1], grams) + np.arange(begins[-1])
    size = np.repeat(np.minimum(count, words), grams).astype(np.uint64)
    out = size.copy()
    for k in range(words):
        part = padded[at + k]
        part[size <= k] = 0
        out = out * _FACTOR + part
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out, begins


def band_hashes(values: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band: of the minima of ``rows`` permutations. Texts without n-grams get 0."""
    rng = np.random.default_rng(23)
    masks = rng.integers(0, 1 << 63, size=bands * rows).astype(np.uint64)
    odd = rng.integers(0, 1 << 62, size=bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    full = begins[1:] > begins[:-1]
    out = np.zeros((len(begins) - 1, bands), dtype=np.uint64)
    if not full.any():
        return out.view(np.int64)
    starts = begins[:-1][full]
    for band in range(bands):
        mixed = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(rows):
            j = band * rows + row
            mixed = mixed * _FACTOR + np.minimum.reduceat((values ^ masks[j]) * odd[j], starts)
            mixed ^= mixed >> np.uint64(32)
        out[full, band] = mixed
    return out.view(np.int64)


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``k1, k2, doc_id, bytes, bands`` of every document."""

    def run(batches):
        for batch in batches:
            values, begins = shingles(batch.column(4), words)
            hashed = band_hashes(values, begins, bands, rows)
            lists = [h if b > a else None for h, a, b in zip(hashed.tolist(), begins, begins[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.list_(pa.int64()))], ["k1", "k2", "doc_id", "bytes", "bands"])

    plain = docs.select(*text_key("text"), F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    return map_arrow(plain, run, "k1 long, k2 long, doc_id long, bytes long, bands array<long>", 500)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        tags = list(zip(*columns, strict=True))
        begin = 0
        for i, tag in enumerate(tags):
            if tag != last:
                if last is not None:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, tag
        if len(tags) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members every two sets have in common, by products of incidence columns."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    codes, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    keep = often[inverse]
    owner, inverse = owner[keep], column[inverse[keep]]
    out = np.zeros((n, n), dtype=np.float64)
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total = int(often.sum())
    for begin in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(inverse, (begin, begin + COLUMNS))
        block = np.zeros((n, min(COLUMNS, total - begin)), dtype=np.float32)
        block[owner[lo:hi], inverse[lo:hi] - begin] = 1
        out += block @ block.T
    return out


def _verify(table: pa.Table, words: int, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Ids, linked documents and smallest linked id (through links here) of the texts of a tile pair."""
    ids = table.column("tid").to_numpy()
    _, first = np.unique(ids, return_index=True)
    table = table.take(pa.array(first))
    ids, tiles = table.column("tid").to_numpy(), table.column("tile").to_numpy()
    values, begins = shingles(table.column("text").combine_chunks(), words)
    sets = [np.unique(values[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
    meet = np.zeros((len(ids), len(ids)), dtype=bool)
    for band in bands.T:
        meet |= band[:, None] == band[None, :]
    if table.column("t")[0].as_py() != table.column("s")[0].as_py():
        meet &= tiles[:, None] != tiles[None, :]  # pairs of one tile are seen where it meets itself
    np.fill_diagonal(meet, False)
    common = shared_counts(sets)
    union = sizes[:, None] + sizes[None, :] - common
    linked = meet & (common >= threshold * union - 1e-9)
    weight = linked @ table.column("copies").to_numpy().astype(np.float64)
    root = np.arange(len(ids))
    while True:  # ids ascend, so the smallest position is the smallest id
        least = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return ids.tolist(), weight.astype(np.int64).tolist(), ids[root].tolist()


def text_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Distinct texts with their links: ``k1, k2, copies, first_id, tid, class_tid, class_id, n_links``.

    Texts meet where they share a band. The texts that such meetings connect form a group; a group is
    dealt out in tiles, every two tiles meet in one task, and pairs that share a band are verified
    there on their full n-gram sets. Tasks return one row a text (its number of links, its smallest
    linked text), never pairs, so a group of near copies costs its tiles and no quadratic output.
    """
    bands, rows = bands_for(threshold, recall)
    sketches = _sketches(docs, words, bands, rows)
    texts = written(
        sketches.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
        .withColumn("tid", F.monotonically_increasing_id())
    )
    buckets = texts.where("bands is not null").select("tid", F.explode("bands").alias("hash"))  # a hash carries its band
    heads = buckets.groupBy("hash").agg(F.min("tid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = buckets.join(heads, "hash").where("tid <> head").select(F.col("tid").alias("u"), F.col("head").alias("v"))
    groups = written(components(met))
    members = written(texts.join(groups.select(F.col("id").alias("tid"), "component"), "tid"))
    tiles = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int").alias("tiles")
    )
    placed = members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("tid"), "tiles").cast("int"))
    # a text's row is read where its text is; copies of the text are dropped in the task
    holders = docs.select(*text_key("text"), F.col("doc_id").cast("long").alias("holder"), "text")
    with_text = holders.join(
        placed.select("k1", "k2", "first_id", "component", "tiles", "tile", "tid", "copies", "bands"), ["k1", "k2"]
    ).where(F.col("holder").eqNullSafe(F.col("first_id")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    meetings = with_text.select("*", other).select(
        "component", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("s"), "tile", "tid", "copies", "bands", "text"
    )

    def run(batches):
        for table in _groups(batches, 3):
            ids, links, roots = _verify(table, words, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], ["tid", "links", "root"])

    keys = ["component", "t", "s"]
    dealt = meetings.repartition(width(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    found = written(map_arrow(dealt, run, "tid long, links long, root long", 200))
    joined = components(found.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    labelled = (
        texts.drop("bands", "bytes")
        .join(links, "tid", "left")
        .join(joined.withColumnRenamed("id", "tid"), "tid", "left")
        .withColumn("class_tid", F.coalesce("component", "tid"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        .drop("component", "links")
    )
    labelled = written(labelled)
    classes = labelled.groupBy("class_tid").agg(F.min("first_id").alias("class_id"))
    return labelled.join(classes, "class_tid")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` of every document.

    Documents link if their sets of word n-grams have a Jaccard similarity of ``threshold`` or more;
    pairs at the threshold meet with probability ``recall``, more similar ones almost surely. Equal
    texts always link, empty and null ones included (null counts as empty); a text without words links
    with nothing else. ``class_id`` is the smallest ``doc_id`` that links reach, ``n_links`` the number
    of other rows linked directly. Rows with equal ``doc_id`` are separate documents; null ids never
    name a class unless all are null. Other columns are ignored; an empty table gives no rows.
    """
    classes = text_classes(docs, words, threshold, recall)
    keyed = docs.select("doc_id", *text_key("text"))
    return keyed.join(classes.select("k1", "k2", "class_id", "n_links"), ["k1", "k2"]).select(
        "doc_id", "class_id", F.col("n_links").cast("long"), (F.col("doc_id") == F.col("class_id")).alias("kept")
    )


def keep_representatives(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` per class, with its columns: the smallest ``doc_id``, the smaller key on ties."""
    names = docs.columns
    classes = text_classes(docs, words, threshold, recall)
    best = classes.groupBy("class_tid").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "k1", "k2")).alias("b"))
    chosen = best.select(F.col("b.k1").alias("k1"), F.col("b.k2").alias("k2"), F.col("b.first_id").alias("first_id"))
    rows = docs.select(F.struct(*names).alias("row"), *text_key("text"), F.col("doc_id").cast("long").alias("holder"))
    kept = rows.join(chosen, ["k1", "k2"]).where(F.col("holder").eqNullSafe(F.col("first_id"))).dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
