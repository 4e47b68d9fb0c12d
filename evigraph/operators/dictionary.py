"""Dictionary names inside texts, aliases, and removal of overlapping spans.

Dictionary tables carry ``concept_id, name, display_name, concept_type, load_seq`` with lower-case
names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut_lineage, once

# A dictionary whose names have up to this many bytes is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
# The run filter takes 32 bits a name, at most 2^27 bits (16 MB); a larger dictionary only lets more runs pass.
FILTER_POWERS = (12, 27)
SLICE = 1 << 20
# characters looked at together while names are placed; arrays of this length stay in a core's cache
STRETCH = 1 << 17
# names kept of a text: all, the longest at each start, those left when overlaps are removed
ALL, STARTS, ALONE = "all", "starts", "alone"

GENERIC_WORDS = ["syndrome", "disease", "disorder", "condition", "symptom"]


SHORT_GRAM, LONG_GRAM = 3, 6


def grams(c: Column, n: int) -> Column:
    """All distinct runs of n characters of a text, in one linear regex pass."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)(?=(.{%d}))" % n), F.lit(1)))


def anchor_grams(c: Column, short: bool = True, long: bool = True) -> Column:
    """Runs of a text that may be the anchor of a name in it."""
    sizes = [n for n, on in ((SHORT_GRAM, short), (LONG_GRAM, long)) if on]
    return F.concat(*[grams(c, n) for n in sizes]) if sizes else F.array().cast("array<string>")


def last_loaded(names: DataFrame) -> DataFrame:
    """One concept per (type, name): the last one loaded."""
    return names.groupBy("concept_type", "name").agg(
        F.max_by(F.struct("concept_id", "display_name", "load_seq"), "load_seq").alias("_c")
    ).select("concept_type", "name", "_c.concept_id", "_c.display_name", "_c.load_seq")


def with_anchor(names: DataFrame, name_col: str = "name", key_cols: tuple[str, ...] = ("concept_type", "name")) -> DataFrame:
    """Each name's rarest run of characters among all names, long runs for long names.

    Any text containing the name contains its anchor.
    """
    c = F.col(name_col)
    own = F.when(F.char_length(c) >= LONG_GRAM, grams(c, LONG_GRAM)).otherwise(grams(c, SHORT_GRAM))
    parts = names.select(*key_cols, F.explode(own).alias("anchor"))
    rarity = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_df"))
    best = parts.join(rarity, "anchor").groupBy(*key_cols).agg(
        F.min_by("anchor", F.struct("_df", "anchor")).alias("anchor")
    )
    return names.join(best, list(key_cols))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _run_codes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit code of the run of n characters that starts at each place."""
    if len(points) < n:
        return np.empty(0, dtype=np.uint64)
    points = points.astype(np.uint64)
    code = np.full(len(points) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        code = (code + points[i:len(points) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return code


def _passing(code: np.ndarray, lookup: np.ndarray, power: int) -> np.ndarray:
    """Places whose code passes the run filter."""
    at = np.arange(len(code))
    for shift in FILTER_SHIFTS:
        bit = (code[at] >> np.uint64(shift)) & np.uint64((1 << power) - 1)
        at = at[(lookup[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _text_codes(text: str, lookup: np.ndarray | None, power: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Distinct 64-bit codes of a text's runs, those that pass the filter where there is one."""
    found = []
    for first in range(0, max(len(text), 1), SLICE):
        # neighbouring slices share the characters of a run that crosses their border
        points = _points(text[first:first + SLICE + LONG_GRAM - 1])
        for n in sizes:
            code = _run_codes(points, n)
            found.append(np.unique(code if lookup is None else code[_passing(code, lookup, power)]))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, dtype=np.int64)


# bit positions of a code in the run filter start at these bits
FILTER_SHIFTS = (0, 18, 37)


def run_codes(lookup: np.ndarray | None = None, power: int = 0, sizes: tuple[int, ...] = (SHORT_GRAM, LONG_GRAM)) -> Callable[[Column], Column]:
    """Function from a text column to the array of its run codes, Arrow batch by Arrow batch.

    Null and texts shorter than a run give an empty array. Equal runs have equal codes; different runs may,
    so whoever joins on them verifies.
    """

    def codes(texts: pa.Array) -> pa.Array:
        values = [np.empty(0, dtype=np.int64) if t is None else _text_codes(t, lookup, power, sizes) for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(v) for v in values])
        flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

    return F.arrow_udf(codes, "array<bigint>")


def run_filter(anchors: DataFrame, names: int) -> tuple[np.ndarray, int]:
    """Bloom filter over the column ``anchor``: words of 64 bits and the power of two of its bits.

    Built by a grouped bit_or; what reaches the driver is the filter itself, at most 16 MB.
    """
    low, high = FILTER_POWERS
    power = min(max(low, (32 * names - 1).bit_length()), high)
    at = [F.shiftrightunsigned("anchor", s).bitwiseAND(F.lit((1 << power) - 1)) for s in FILTER_SHIFTS]
    words = (
        anchors.select(F.explode(F.array(*at)).alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()
    )
    lookup = np.zeros(1 << (power - 6), dtype=np.uint64)
    lookup[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return lookup, power


def with_run(names: DataFrame) -> DataFrame:
    """Each name (column ``name``) with the code of its rarest run among all names, long runs for long names."""
    c = F.col("name")
    texts = names.select("name").distinct()
    long = F.char_length(c) >= LONG_GRAM
    of = lambda n, own: texts.where(own).select("name", F.explode(run_codes(sizes=(n,))(c)).alias("anchor"))
    parts = cut_lineage(of(LONG_GRAM, long).unionByName(of(SHORT_GRAM, ~long)))
    rarity = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_df"))
    best = parts.join(rarity, "anchor").groupBy("name").agg(F.min_by("anchor", F.struct("_df", "anchor")).alias("anchor"))
    return names.join(best, "name")


class NameTable:
    """A dictionary of bounded size as arrays: code points of the names and the entries of every run.

    Entries are ordered by concept type, so that of two names at one place the smaller number is the first type.
    """

    def __init__(self, keyed: pa.Table):
        kinds = keyed["concept_type"].to_pylist()
        order = sorted(range(len(kinds)), key=lambda i: (kinds[i] is None, kinds[i] or ""))
        self.rows = keyed.take(pa.array(order, pa.int64())).combine_chunks()
        self.entry = self.rows["entry"].to_numpy()
        points = [_points(n) for n in self.rows["name"].to_pylist()]
        self.length = np.array([len(p) for p in points], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.points = np.concatenate(points) if points else np.empty(0, dtype=np.uint32)
        anchor = self.rows["anchor"].to_numpy().view(np.uint64)
        self.offset = np.zeros(len(points), dtype=np.int64)
        for i, p in enumerate(points):
            n = LONG_GRAM if len(p) >= LONG_GRAM else SHORT_GRAM
            self.offset[i] = np.flatnonzero(_run_codes(p, n) == anchor[i])[0]
        self.by_run = np.argsort(anchor, kind="stable")
        self.runs, self.run_first, self.run_count = np.unique(anchor[self.by_run], return_index=True, return_counts=True)


def _occurrences(points: np.ndarray, word: np.ndarray | None, names: NameTable, lookup: np.ndarray, power: int,
                 sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All places and numbers of names in a stretch of characters; ``word`` (shifted by one: is
    the character before a place one of a word) admits whole words only."""
    starts, numbers = [], []
    for n in sizes:
        code = _run_codes(points, n)
        at = _passing(code, lookup, power)
        run = np.searchsorted(names.runs, code[at])
        known = run < len(names.runs)
        at, run = at[known], run[known]
        known = names.runs[run] == code[at]
        at, run = at[known], run[known]
        # a run may belong to many names: so many places at a time that their pairs stay few
        count = np.cumsum(names.run_count[run])
        low = 0
        while low < len(at):
            done = count[low - 1] if low else 0
            high = max(int(np.searchsorted(count, done + SLICE, "right")), low + 1)
            times = names.run_count[run[low:high]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            number = names.by_run[np.repeat(names.run_first[run[low:high]], times) + within]
            start = np.repeat(at[low:high], times) - names.offset[number]
            length = names.length[number]
            fits = (start >= 0) & (start + length <= len(points))
            if word is not None:
                fits[fits] &= word[start[fits]] == 0
                fits[fits] &= word[start[fits] + length[fits] + 1] == 0
            start, number = start[fits], number[fits]
            equal = np.ones(len(start), dtype=bool)
            left, k = np.arange(len(start)), 0
            while len(left):
                left = left[names.length[number[left]] > k]
                same = points[start[left] + k] == names.points[names.first[number[left]] + k]
                equal[left[~same]] = False
                left, k = left[same], k + 1
            starts.append(start[equal])
            numbers.append(number[equal])
            low = high
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *numbers])


def _alone(row: np.ndarray, start: np.ndarray, end: np.ndarray, chain: bool) -> np.ndarray:
    """Of hits ordered by row, start, longest first: the first of each start; with ``chain`` none that overlaps the one kept before."""
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1])
    at = np.flatnonzero(fresh)
    if not chain:
        return at
    kept, last, until = [], -1, 0
    for i, r, s, e in zip(at.tolist(), row[at].tolist(), start[at].tolist(), end[at].tolist()):
        if r != last or s >= until:
            kept.append(i)
            last, until = r, e
    return np.array(kept, dtype=np.int64)


def _groups(texts: list[str | None], step: int):
    """Rows in groups of about ``step`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for row, text in enumerate(texts):
        length = len(text) if text else 0
        if group and size + length > step:
            yield group
            group, size = [], 0
        group.append(row)
        size += length
    if group:
        yield group


def _first_places(texts: list[str], marks: list[str] | None, table: NameTable, lookup: np.ndarray, power: int,
                  sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, name and first place of every name in the texts, in this order."""
    longest = int(table.length.max(initial=1))
    step = max(STRETCH, 2 * longest)
    found = [(np.empty(0, dtype=np.int64),) * 3]
    # a long text is read in pieces that share the characters of a name that crosses their border
    pieces = [(row, at, text[at:at + step + longest]) for row, text in enumerate(texts) for at in range(0, len(text), step)]
    for some in [pieces] if len(texts) > 1 else [[p] for p in pieces]:
        # two characters that no name has part the pieces
        points = _points("\0\0".join(p for _, _, p in some)).copy()
        base = np.cumsum([0, *[len(p) + 2 for _, _, p in some]])[:-1]
        points[np.concatenate([base[1:] - 1, base[1:] - 2])] = 0xFFFFFFFF
        word = None
        if marks is not None:
            word = np.zeros(len(points) + 2, dtype=np.uint8)
            for first, (row, at, piece) in zip(base.tolist(), some):
                around = _points((" " if at == 0 else "") + marks[row][max(at - 1, 0):at + len(piece) + 1])
                word[first:first + len(around)] = around != ord(" ")
        start, number = _occurrences(points, word, table, lookup, power, sizes)
        piece = np.searchsorted(base, start, "right") - 1
        row, at = (np.array([p[i] for p in some], dtype=np.int64)[piece] for i in (0, 1))
        found.append((row, number, start - base[piece] + at))
    row, number, place = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((place, number, row))
    row, number, place = row[order], number[order], place[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    return row[new], number[new], place[new]


def name_places(names: Broadcast, lookup: np.ndarray, power: int, sizes: tuple[int, ...], word_bounded: bool,
                keep: str, columns: tuple[str, ...] = ()) -> Column:
    """Array of ``entry, start, end, mention`` and dictionary columns: the first place of every name in ``_low``.

    All is made in the text's row, the mention too: cut out there it costs its own length, not the text's. ``names`` is a broadcast :class:`NameTable`. ``keep``: all names, only the longest at each start, or only those
    left when overlaps are removed (see :func:`keep_spans`).
    """

    def places(lows: pa.Array, written: pa.Array, words: pa.Array | None) -> pa.Array:
        table, parts, originals = names.value, [], written.to_pylist()
        texts = [t or "" for t in lows.to_pylist()]
        marks = None if words is None else [w or "" for w in words.to_pylist()]
        for group in _groups(texts, STRETCH):
            row, number, place = _first_places([texts[r] for r in group], marks and [marks[r] for r in group], table, lookup, power, sizes)
            if keep != ALL:
                order = np.lexsort((number, -table.length[number], place, row))
                row, number, place = row[order], number[order], place[order]
                left = _alone(row, place, place + table.length[number], keep == ALONE)
                row, number, place = row[left], number[left], place[left]
            at, end = pa.array(number, pa.int64()), place + table.length[number]
            own = [originals[r] for r in group]
            mentions = [own[r][s:e] for r, s, e in zip(row.tolist(), place.tolist(), end.tolist())]
            flat = pa.StructArray.from_arrays(
                [pa.array(table.entry[number], pa.int64()), pa.array(place, pa.int32()), pa.array(end, pa.int32()), pa.array(mentions, pa.string()),
                 *[table.rows[c].take(at).combine_chunks() for c in columns]],
                names=["entry", "start", "end", "mention", *columns])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(group)))])
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
        return pa.concat_arrays(parts) if parts else pa.array([], _arrow_type(columns))

    kind = "array<struct<" + ",".join(["entry:bigint,start:int,end:int,mention:string", *[f"{c}:string" for c in columns]]) + ">>"

    def plain(lows: pa.Array, written: pa.Array) -> pa.Array:
        return places(lows, written, None)

    def bounded(lows: pa.Array, written: pa.Array, words: pa.Array) -> pa.Array:
        return places(lows, written, words)

    # nondeterministic, so that no filter or projection repeats it
    run = F.arrow_udf(bounded if word_bounded else plain, kind).asNondeterministic()
    # beside the text goes the same text with a blank wherever there is no character of a word
    return run("_low", "text", F.regexp_replace("_low", r"(?U)\W", " ")) if word_bounded else run("_low", "text")


def _arrow_type(columns: tuple[str, ...]) -> pa.DataType:
    return pa.list_(pa.struct([("entry", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("mention", pa.string()), *[(c, pa.string()) for c in columns]]))


class Prepared:
    """A dictionary ready for a scan: written with runs, measured, and where it is small broadcast."""

    def __init__(self, names: DataFrame, broadcast_bytes: int):
        usable = cut_lineage(last_loaded(names.where(F.char_length("name") >= 3)))  # read three times below
        self.keyed = cut_lineage(with_run(usable).select(
            "anchor", "name", "concept_type", "concept_id", "display_name", F.monotonically_increasing_id().alias("entry")))
        size = self.keyed.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("concept_type"), F.lit(0)) + F.coalesce(
                F.octet_length(F.col("concept_id").cast("string")), F.lit(0)) + 64), F.lit(0)).alias("bytes"),
            F.max(F.char_length("name") < LONG_GRAM).alias("short"), F.max(F.char_length("name") >= LONG_GRAM).alias("long"),
        ).first()
        self.sizes = tuple(n for n, on in ((SHORT_GRAM, size["short"]), (LONG_GRAM, size["long"])) if on)
        self.filter = run_filter(self.keyed, max(size["n"], 1))
        self.small = size["bytes"] <= broadcast_bytes
        if self.small:
            table = NameTable(self.keyed.select("anchor", "name", "concept_type", "display_name", "entry").toArrow())
            self.table = names.sparkSession.sparkContext.broadcast(table)

    def places(self, word_bounded: bool, keep: str, columns: tuple[str, ...] = ()) -> Column:
        return name_places(self.table, *self.filter, self.sizes, word_bounded, keep, columns)


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_low", F.lower("text"))


def _found_in_rows(lowered: DataFrame, ready: Prepared, word_bounded: bool, keep: str) -> DataFrame:
    """Span rows of a small dictionary: places are found in the text's row, only numbers are exploded and named."""
    hits = lowered.withColumn("_hits", ready.places(word_bounded, keep)).select("doc_id", F.inline("_hits"))
    return hits.join(F.broadcast(ready.keyed.drop("anchor", "display_name")), "entry").select(
        "doc_id", "start", "end", F.col("concept_type").alias("label"), "name", "concept_id", "mention", F.lit(0.8).alias("confidence"))


def _found_by_shuffle(lowered: DataFrame, ready: Prepared, word_bounded: bool) -> DataFrame:
    """Span rows of a dictionary of any size: ids and runs of names are shuffled, texts come back for the surviving pairs."""
    runs = run_codes(*ready.filter, ready.sizes)(F.col("_low"))
    ids = lowered.select("doc_id", F.explode(runs).alias("anchor"))
    pairs = ids.join(ready.keyed, "anchor").join(lowered, "doc_id")
    at = F.regexp_instr("_low", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("name"), F.lit(r"\E(?!\w)"))) if word_bounded else F.instr(
        F.col("_low"), F.col("name"))
    found = once(pairs.where(F.contains("_low", "name")), "start", at.cast("int") - 1).where(F.col("start") >= 0)
    return found.withColumn("end", (F.col("start") + F.char_length("name")).cast("int")).select(
        "doc_id", "start", "end", F.col("concept_type").alias("label"), "name", "concept_id",
        F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("mention"), F.lit(0.8).alias("confidence"))


def find_names(
    docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    word_bounded: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """First occurrence of every dictionary name (3 characters or more) in every text.

    A name is found by its rarest run of characters. A Bloom filter of these runs is applied where the texts
    lie, so only runs that (almost) surely belong to a name are looked at. A dictionary of up to
    ``broadcast_bytes`` is sent to the tasks, which verify the places of a run character by character inside the
    text's row; of a larger one the surviving runs meet the names by one equi-join and are verified there.
    Positions are zero-based. Null texts and an empty dictionary give no rows.
    """
    ready, lowered = Prepared(names, broadcast_bytes), _lowered(docs, id_col, text_col)
    return _found_in_rows(lowered, ready, word_bounded, ALL) if ready.small else _found_by_shuffle(lowered, ready, word_bounded)


def keep_spans(spans: Column) -> Column:
    """Non-overlapping spans of an array of ``struct<start, end, ...>``: earliest start first, the
    longest among equal starts; a span goes when it overlaps one already kept."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .otherwise(F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)),
    )
    # spans are taken by start, so only the end of the last kept one can still overlap
    return F.aggregate(
        ordered,
        F.filter(ordered, lambda s: F.lit(False)),
        lambda kept, s: F.when(
            (F.size(kept) == 0) | (s["start"] >= F.try_element_at(kept, F.lit(-1))["end"]), F.array_append(kept, s)
        ).otherwise(kept),
    )


def remove_overlaps(spans: DataFrame) -> DataFrame:
    """Overlap removal per document; a group is bounded by one text."""
    cols = [c for c in spans.columns if c != "doc_id"]
    return (
        spans.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("_s"))
        .select("doc_id", F.explode(keep_spans(F.col("_s"))).alias("_k")).select("doc_id", "_k.*")
    )


def _repeated(docs: DataFrame, id_col: str) -> DataFrame | None:
    """Ids that more than one text carries, if any; their spans are judged together."""
    ids = cut_lineage(docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_id"))
    return None if ids.isEmpty() else ids


def _parted(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts that have an id of their own, and the others."""
    ids = _repeated(docs, id_col)
    if ids is None:
        return docs, None
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def extract_entities(
    docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    word_bounded: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Dictionary extraction: names in texts, overlaps removed.

    With a small dictionary overlaps go inside the text's row; only texts that share their id are grouped, and of
    those only the longest name at each start, as no other can be kept.
    """
    ready = Prepared(names, broadcast_bytes)
    if not ready.small:
        return remove_overlaps(_found_by_shuffle(_lowered(docs, id_col, text_col), ready, word_bounded))
    own, shared = _parted(docs, id_col)
    found = _found_in_rows(_lowered(own, id_col, text_col), ready, word_bounded, ALONE)
    if shared is None:
        return found
    return found.unionByName(remove_overlaps(_found_in_rows(_lowered(shared, id_col, text_col), ready, word_bounded, STARTS)))


_ANNOTATIONS = "array<struct<entity:string,display_name:string,position:int>>"


def _annotations_by_group(docs: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """Texts with the spans of their id as annotation arrays."""
    found = found.join(last_loaded(names).select(F.col("concept_type").alias("label"), "name", "display_name"), ["label", "name"])
    item = F.struct(F.col("mention").alias("entity"), "display_name", F.col("start").alias("position"))
    pick = lambda kind: F.array_sort(
        F.collect_list(F.when(F.col("label") == kind, item)),
        lambda a, b: a["position"] - b["position"],
    )
    grouped = found.groupBy("doc_id").agg(pick("DISEASE").alias("diseases"), pick("SYMPTOM").alias("symptoms"))
    return docs.join(grouped, "doc_id", "left")


def annotate(
    docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    word_bounded: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Texts with their entities as annotation arrays; texts without any keep empty arrays.

    With a small dictionary a text with an id of its own is annotated inside its row.
    """
    ready = Prepared(names, broadcast_bytes)
    texts = lambda some: some.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    none = F.array().cast(_ANNOTATIONS)
    shape = lambda df: df.select(
        F.col("doc_id").cast("string").alias("id"), "text",
        F.coalesce("diseases", none).alias("diseases"), F.coalesce("symptoms", none).alias("symptoms"))
    if not ready.small:
        found = remove_overlaps(_found_by_shuffle(_lowered(docs, id_col, text_col), ready, word_bounded))
        return shape(_annotations_by_group(texts(docs), found, names))
    own, shared = _parted(docs, id_col)
    spans = _lowered(own, id_col, text_col).withColumn("_hits", ready.places(word_bounded, ALONE, ("concept_type", "display_name")))
    # a text without an id is not found again by its id
    pick = lambda kind: F.when(F.col("doc_id").isNotNull(), F.transform(
        F.filter("_hits", lambda h: h["concept_type"] == kind),
        lambda h: F.struct(h["mention"].alias("entity"), h["display_name"].alias("display_name"), h["start"].alias("position"))))
    out = shape(spans.withColumns({"diseases": pick("DISEASE"), "symptoms": pick("SYMPTOM")}))
    if shared is None:
        return out
    found = remove_overlaps(_found_in_rows(_lowered(shared, id_col, text_col), ready, word_bounded, STARTS))
    return out.unionByName(shape(_annotations_by_group(texts(shared), found, names)))


def alias_array(name: Column) -> Column:
    """Aliases of a name in writing order: itself, without generic words, first and last word,
    without bracketed parts."""
    cleaned = F.regexp_replace(name, r"(?U)\b(" + "|".join(GENERIC_WORDS) + r")\b", "")
    cleaned = F.regexp_replace(cleaned, r"(?U)^\s+|\s+$", "")
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    several = name.contains(" ") & (F.size(words) >= 2)
    unbracketed = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", ""), r"(?U)^\s+|\s+$", "")
    changed = lambda c: F.when((c != "") & (c != name), c)
    return F.filter(
        F.array(name, changed(cleaned), F.when(several, F.get(words, 0)),
                F.when(several, F.try_element_at(words, F.lit(-1))), changed(unbracketed)),
        lambda a: a.isNotNull(),
    )


def alias_table(names: DataFrame) -> DataFrame:
    """Concept per (type, alias); the last writer in load order wins."""
    written = names.select("concept_type", "concept_id", "load_seq", F.posexplode(alias_array(F.col("name"))).alias("_p", "alias"))
    return written.groupBy("concept_type", "alias").agg(
        F.max_by("concept_id", F.struct("load_seq", "_p")).alias("concept_id"), F.max("load_seq").alias("load_seq")
    )
