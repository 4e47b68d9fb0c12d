"""Token ids of whole texts and the exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.ordered import spread_running
from evigraph.llm.common import map_arrow, written

TOKENIZER = "word_bpe_49k.json"
# Bytes of words and ids that a worker remembers, words encoded at a time and words joined at a time.
REMEMBERED = 64 << 20
JOINED = 500
GATHERED = 250_000
# Letters, but for the one whose lower case ends in a mark (U+0130).
LETTERS = r"[^\PL\x{130}]+"

_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _load(path: str) -> dict:
    """Tokenizer, which ids end a word, and the remembered words; kept for the life of a worker."""
    if _state.get("path") != path:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # a text that spells a special token stays ordinary text
        ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, i in tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        _state.update(path=path, tokenizer=tokenizer, ends=ends)
        forget()
    return _state


def forget() -> None:
    """Empty the word memory of a worker, as after the last batch of a task."""
    _state.update(words=pa.array([], pa.large_string()), ids=np.empty(0, "<u4"), sizes=np.empty(0, np.int64))


def _encode(state: dict, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after the other, and how many each has.

    Words of letters only are joined: each ends at its end-of-word token. A word is a run without
    ASCII white space, or a part of one.
    """
    tokenizer, ends = state["tokenizer"], state["ends"]
    plain = pc.match_substring_regex(words, f"^{LETTERS}$").to_numpy(zero_copy_only=False).astype(bool)
    listed = words.to_pylist()
    sizes = np.zeros(len(listed), dtype=np.int64)
    found, places = [], []
    at = np.flatnonzero(plain)
    chunks = [at[i : i + JOINED] for i in range(0, len(at), JOINED)]
    alone = np.flatnonzero(~plain).tolist()
    joined = tokenizer.encode_batch_fast([" ".join([listed[i] for i in c.tolist()]) for c in chunks], add_special_tokens=False)
    for chunk, encoded in zip(chunks, joined, strict=True):
        ids = np.array(encoded.ids, dtype="<u4")
        stops = np.flatnonzero(ends[ids]) + 1 if len(ids) else np.empty(0, dtype=np.int64)
        if len(stops) == len(chunk):
            sizes[chunk] = np.diff(stops, prepend=0)
            found.append(ids)
            places.append(chunk)
        else:  # a letter whose lower case is not a letter alone
            alone.extend(chunk.tolist())
    for i, encoded in zip(alone, tokenizer.encode_batch_fast([listed[i] for i in alone], add_special_tokens=False), strict=True):
        ids = np.array(encoded.ids, dtype="<u4")
        sizes[i] = len(ids)
        found.append(ids)
        places.append(np.array([i]))
    if not found:
        return np.empty(0, "<u4"), sizes
    # back into the order of the words
    order = np.concatenate(places)
    flat = np.concatenate(found)
    starts = np.empty(len(listed), dtype=np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return _gather(flat, starts, sizes), sizes


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(sizes.sum())]


def _remembered(state: dict, parts: pa.Array) -> np.ndarray:
    """Positions in the word memory of all ``parts`` (distinct), which are encoded where they are new.

    A memory that would grow too large is emptied first and learns all parts anew.
    """
    held = pc.index_in(parts, state["words"])
    fresh = parts.filter(held.is_null())
    size = state["words"].nbytes + state["ids"].nbytes + state["sizes"].nbytes
    if len(state["words"]) and size + 4 * fresh.nbytes > REMEMBERED:
        forget()
        return _remembered(state, parts)
    if len(fresh):
        ids, sizes = _encode(state, fresh)
        positions = held.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        positions[positions < 0] = len(state["words"]) + np.arange(len(fresh))
        state["words"] = pa.concat_arrays([state["words"], fresh])
        state["ids"] = np.concatenate((state["ids"], ids))
        state["sizes"] = np.concatenate((state["sizes"], sizes))
        return positions
    return held.to_numpy(zero_copy_only=False)


def encode_texts(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Token ids of every text as little-endian unsigned 32-bit integers; null encodes to nothing.

    The tokenizer drops white space and lowers case, so a text's ids are those of its words in turn
    and each distinct word is encoded once. Letters followed by marks encode as the two parts; an
    apostrophe may join them, so a word that has one is encoded whole.
    """
    state = _load(path)
    if texts.offset:  # pyarrow's ascii kernels misread sliced arrays
        texts = texts.take(pa.array(np.arange(len(texts))))
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    pieces = pc.ascii_split_whitespace(lowered)
    coded = pc.dictionary_encode(pieces.flatten())
    words = coded.dictionary
    split = pc.extract_regex(words, rf"^(?P<a>{LETTERS})(?P<b>[!-&(-/:-@\[-`{{-~]*)$")
    first = pc.coalesce(pc.struct_field(split, "a"), words)
    marks = pc.fill_null(pc.struct_field(split, "b"), "")
    marked = pc.not_equal(marks, "")
    parts = pc.dictionary_encode(pa.concat_arrays([first, marks.filter(marked)]))
    held = _remembered(state, parts.dictionary)
    part = held[parts.indices.to_numpy()] if len(parts) else np.empty(0, np.int64)
    # one or two parts a word: positions in the memory, -1 for none
    pair = np.full((len(words), 2), -1, dtype=np.int64)
    pair[:, 0] = part[: len(words)]
    pair[marked.to_numpy(zero_copy_only=False), 1] = part[len(words) :]
    ids, sizes = state["ids"], state["sizes"]
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    text = 0
    while text < len(texts):
        # whole texts, about GATHERED words at a time
        upto = max(text + 1, int(np.searchsorted(offsets, offsets[text] + GATHERED, "right")) - 1)
        used = pair[codes[offsets[text] : offsets[upto]]]
        count = np.where(used >= 0, sizes[used], 0) if len(sizes) else np.zeros(used.shape, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(count.sum(axis=1))))[offsets[text : upto + 1] - offsets[text]]
        flat = used.ravel()
        flat = flat[flat >= 0]
        data = _gather(ids, starts[flat], sizes[flat]).tobytes()
        for begin, end in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            yield data[4 * begin : 4 * end]
        text = upto


def length_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens, docs``: how many documents have each encoded length. Null and empty texts have 0."""
    path = path or default_tokenizer()

    def lengths(batches):
        for batch in batches:
            n = [len(x) // 4 for x in encode_texts(batch.column(0), path)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["tokens"])
        forget()

    return map_arrow(docs.select("text"), lengths, "tokens long").groupBy("tokens").agg(F.count(F.lit(1)).alias("docs"))


def token_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The exact length histogram with its suffix sums, one row per encoded length that occurs.

    Columns: ``tokens`` (length without special tokens), ``docs``, ``longer_docs`` and
    ``longer_tokens`` (sums over the longer documents), ``total_docs``, ``total_tokens``, ``quantile``
    (part of the documents that are no longer) and ``truncated_total``, the tokens left when every
    document is cut to this length. Between two rows the truncated total grows by ``longer_docs`` a
    token, so the table answers every context limit; see :func:`context_limits`. An empty table gives
    no rows. Columns other than ``text`` are ignored.

    Sums run in two levels (ranges of 256 lengths), so no task holds the whole histogram.
    """
    counts = written(length_counts(docs, path)).withColumns({"all": F.lit(1), "mass": F.col("tokens") * F.col("docs")})
    totals = counts.agg(F.sum("docs").alias("total_docs"), F.sum("mass").alias("total_tokens"))
    group, order = ["all"], ["tokens"]
    ranged = F.shiftright("tokens", 8)
    upto = spread_running(counts, group, ranged, order, F.col("docs"), "upto_docs")
    upto = spread_running(upto, group, ranged, order, F.col("mass"), "upto_tokens")
    # one row of totals
    both = upto.join(F.broadcast(totals.withColumn("all", F.lit(1))), "all")
    longer = F.col("total_docs") - F.col("upto_docs")
    return both.select(
        "tokens", "docs", longer.alias("longer_docs"), (F.col("total_tokens") - F.col("upto_tokens")).alias("longer_tokens"),
        "total_docs", "total_tokens", (F.col("upto_docs") / F.col("total_docs")).alias("quantile"),
        (F.col("upto_tokens") + F.col("tokens") * longer).alias("truncated_total"),
    )


def context_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents that fit and tokens that stay at each limit, from the rows of a histogram."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context long")
    fits = F.col("tokens") <= F.col("context")
    # the stated limits are a short list
    return (
        histogram.crossJoin(F.broadcast(asked))
        .groupBy("context")
        .agg(
            F.coalesce(F.sum(F.when(fits, F.col("docs"))), F.lit(0)).alias("fitting_docs"),
            F.sum(F.least("tokens", "context") * F.col("docs")).alias("truncated_total"),
        )
    )
