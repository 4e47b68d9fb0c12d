"""Cutting documents into chunks: sections, paragraphs, sliding windows, and the strategy over them.

Everything happens inside a document's own row, on arrays of ``struct<text, start, end, kind,
section>`` with absolute offsets; the only row multiplication is the final explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
SECTION_HEADERS = [
    "chief complaint",
    "history of present illness",
    "past medical history",
    "medications",
    "physical examination",
    "assessment and plan",
    "impression",
    "diagnosis",
    "treatment plan",
    "laboratory results",
    "vital signs",
    "allergies",
    "social history",
    "family history",
    "review of systems",
]
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

_HEADER = "(?:" + "|".join(SECTION_HEADERS) + ")"
_CHUNK = "struct<text:string,start:int,end:int,kind:string,section:string>"


def _chunk(text: Column, start: Column, end: Column, kind: str, section: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if section is None else section).alias("section"),
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")


def window_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, offset: Column | None = None,
                  section: Column | None = None) -> Column:
    """Windows of ``size`` characters every ``size - overlap``; blank windows are left out."""
    _check(size, overlap)
    step = size - overlap
    length = F.char_length(text)
    count = F.when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1).cast("int")
    base = F.lit(0) if offset is None else offset
    made = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: _chunk(
            F.substr(text, i * step + 1, F.lit(size)), base + i * step, base + F.least(i * step + size, length),
            "window", section,
        ),
    )
    return F.filter(made, lambda c: _strip(c["text"]) != "")


def _with_offsets(pieces: Column) -> Column:
    """Consecutive pieces of a text with their start offsets."""
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<piece:string,start:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p)).cast("int").alias("at"),
            F.array_append(s["out"], F.struct(p.alias("piece"), s["at"].alias("start"))).alias("out"),
        ),
        lambda s: s["out"],
    )


def section_chunks(text: Column, keep_preamble: bool = False) -> Column:
    """One chunk per header line; the whole text when there is none.

    Text before the first header is dropped unless ``keep_preamble``.
    """
    pieces = _with_offsets(F.split(text, rf"(?im)(?=^{_HEADER}:?[^\S\n]*$)"))
    named = rf"(?i)^({_HEADER}):?[^\S\n]*(?:\n|$)"
    is_section = lambda p: p["piece"].rlike(named)
    kept = pieces if keep_preamble else F.filter(pieces, is_section)
    chunks = F.transform(
        F.filter(kept, lambda p: _strip(p["piece"]) != ""),
        lambda p: _chunk(
            _strip(p["piece"]), p["start"], p["start"] + F.char_length(p["piece"]), "section",
            F.nullif(F.lower(F.regexp_extract(p["piece"], named, 1)), F.lit("")),
        ),
    )
    whole = F.array(_chunk(text, F.lit(0), F.char_length(text), "chunk"))
    return F.when(F.exists(pieces, is_section), chunks).otherwise(whole)


def paragraph_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed up to ``size`` characters; a new chunk starts with the tail of the last one.

    Offsets run from the first newly added paragraph to the end of the last one.
    """
    _check(size, overlap)
    pieces = _with_offsets(F.split(text, r"(?U)(?<=\n)(?=\s*\n)"))
    paragraphs = F.filter(
        F.transform(
            pieces,
            lambda p: F.struct(
                _strip(p["piece"]).alias("text"),
                (p["start"] + F.char_length(F.regexp_extract(p["piece"], r"(?U)^\s*", 0))).cast("int").alias("start"),
            ),
        ),
        lambda p: p["text"] != "",
    )
    empty = F.struct(
        F.lit("").alias("cur"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        F.array().cast(f"array<{_CHUNK}>").alias("out"),
    )
    done = lambda s: _chunk(_strip(s["cur"]), s["start"], s["end"], "semantic")

    def step(s: Column, p: Column) -> Column:
        end = (p["start"] + F.char_length(p["text"])).cast("int")
        full = (F.char_length(s["cur"]) + F.char_length(p["text"]) > size) & (s["cur"] != "")
        tail = F.concat(F.right(s["cur"], F.lit(overlap)), F.lit("\n\n"), p["text"]) if overlap else p["text"]
        return (
            F.when(full, F.struct(tail.alias("cur"), p["start"].alias("start"), end.alias("end"),
                                  F.array_append(s["out"], done(s)).alias("out")))
            .when(s["cur"] == "", F.struct(p["text"].alias("cur"), p["start"].alias("start"), end.alias("end"),
                                           s["out"].alias("out")))
            .otherwise(F.struct(F.concat(s["cur"], F.lit("\n\n"), p["text"]).alias("cur"), s["start"].alias("start"),
                                end.alias("end"), s["out"].alias("out")))
        )

    return F.aggregate(
        paragraphs, empty, step,
        lambda s: F.when(s["cur"] != "", F.array_append(s["out"], done(s))).otherwise(s["out"]),
    )


def document_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep_preamble: bool = False) -> Column:
    """Sections; one chunk over twice the size becomes paragraphs; any chunk over the size, windows."""
    sections = section_chunks(text, keep_preamble)
    oversize = (F.size(sections) == 1) & (F.char_length(F.get(sections, 0)["text"]) > 2 * size)
    base = F.when(oversize, paragraph_chunks(text, size, overlap)).otherwise(sections)
    return F.flatten(
        F.transform(
            base,
            lambda c: F.when(
                F.char_length(c["text"]) > size, window_chunks(c["text"], size, overlap, c["start"], c["section"])
            ).otherwise(F.array(c)),
        )
    )


def chunk_rows(documents: DataFrame, chunks: Column, id_col: str = "document_id", metadata_col: str | None = None) -> DataFrame:
    """Storage rows of a chunk array: text, ids, index, offsets and metadata (with the section)."""
    meta = F.col(metadata_col) if metadata_col else F.create_map().cast("map<string,string>")
    rows = documents.select(F.col(id_col).cast("string").alias("document_id"), meta.alias("_m"),
                            F.posexplode(chunks).alias("chunk_index", "c"))
    section = F.when(F.col("c.section").isNotNull(), F.create_map(F.lit("section"), F.col("c.section"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return rows.select(
        F.col("c.text").alias("text"),
        F.concat_ws("_", "document_id", "c.kind", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "document_id", "chunk_index", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"),
        F.map_concat("_m", section).alias("metadata"),
    )
