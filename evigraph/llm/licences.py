"""Licence scans: Aho-Corasick over notice phrases and tags, shunting-yard over licence expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import map_arrow

# Fixed values that results depend on: phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that the method adds: phrase, label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
}
# Identifier prefixes (lower case) of licences that ask for no more than attribution.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "unlicense", "zlib", "cc0", "cc-by-4", "cc-by-3", "bsl", "0bsd")

TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# ASCII outside 0-9, A-Z, a-z separates words; A-Z become small letters; all other bytes stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
RESULT = (
    "doc_id long, n_words long, places array<struct<phrase: string, label: string, word: bigint>>,"
    " expressions array<struct<expression: string, valid: boolean, permissive: boolean, ids: array<string>>>"
)


def parse_expression(text: str) -> list[tuple[str, str]] | None:
    """Reverse Polish form of a licence expression by the shunting-yard method, None if malformed.

    ``with`` binds before ``and``, ``and`` before ``or``. A bare exception (right of ``with``) must be a
    single identifier.
    """
    body = text.strip().rstrip("*/-># \t")
    if TOKEN.sub("", body).strip():
        return None
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    operand_next = True
    for token in TOKEN.findall(body):
        low = token.lower()
        if low in PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[low]:
                out.append(("op", waiting.pop()))
            waiting.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next or waiting and waiting[-1] == "with":
                return None
            waiting.append("(")
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(("op", waiting.pop()))
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(("id", low))
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    out.extend(("op", x) for x in reversed(waiting))
    return out


def evaluate(polish: list[tuple[str, str]]) -> tuple[bool, list[str]]:
    """Whether the expression can be met by permissive licences alone, and its licence identifiers."""
    stack: list[tuple[bool, tuple[str, ...]]] = []
    for kind, value in polish:
        if kind == "id":
            stack.append((value.startswith(PERMISSIVE), (value,)))
            continue
        right, left = stack.pop(), stack.pop()
        if value == "with":  # an exception only adds permissions and is no licence
            stack.append(left)
        elif value == "and":
            stack.append((left[0] and right[0], left[1] + right[1]))
        else:
            stack.append((left[0] or right[0], left[1] + right[1]))
    permissive, ids = stack.pop()
    return permissive, sorted(set(ids))


def scan_licences(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """Where each document names licences.

    ``phrases``: lower-case phrases of words and their labels. One automaton finds the phrases and the
    identifier tag in the words of the whole text (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
    A-Z); only texts with a tag are looked at again for its expression, which ends with its line.

    Result: ``doc_id, n_words, places`` (phrase, label, index of its first word, in text order) and
    ``expressions`` (text, valid, permissive, identifiers). A null text counts as empty: no words, empty
    lists. Malformed expressions are listed with ``valid`` false and no identifiers. Rows with equal
    ``doc_id`` are separate documents; other columns are ignored; an empty table gives no rows.
    Every document is scanned where it is read; nothing is shuffled.
    """
    table = dict(phrases if phrases is not None else BASE | NOTICES)

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in [*table, TAG]:
            automaton.add_word(f" {phrase} ", phrase)
        automaton.make_automaton()
        for batch in batches:
            n_words, places, expressions = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                raw = text.as_py() or b""
                words = raw.translate(FOLD).split()
                n_words.append(len(words))
                folded = b" %b " % b" ".join(words)
                found, tagged, blanks = [], False, None
                # one character a byte, so that positions are those of the bytes
                for end, phrase in automaton.iter(folded.decode("latin-1")):
                    if phrase == TAG:
                        tagged = True
                    else:
                        if blanks is None:
                            blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
                        word = int(np.searchsorted(blanks, end - len(phrase) - 1))
                        found.append({"phrase": phrase, "label": table[phrase], "word": word})
                told = []
                for m in TAG_LINE.finditer(raw) if tagged else ():
                    expression = m[1].decode("utf-8", "replace").strip()
                    polish = parse_expression(expression)
                    permissive, ids = evaluate(polish) if polish else (False, [])
                    told.append({"expression": expression, "valid": bool(polish), "permissive": permissive, "ids": ids})
                places.append(sorted(found, key=lambda p: (p["word"], p["phrase"])))
                expressions.append(told)
            kinds = [
                pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64())])),
                pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_()), ("ids", pa.list_(pa.string()))])),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, kinds[0]), pa.array(expressions, kinds[1])],
                ["doc_id", "n_words", "places", "expressions"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scan, RESULT)


def licence_digest(scan: DataFrame) -> DataFrame:
    """Counts, labels and a score from a scan with the standard phrases.

    ``score`` is 0 without a label, else 1 - 0.4 ^ k for k pieces of evidence, where a notice place
    counts once and a valid identifier tag twice.
    """
    base = F.filter("places", lambda p: p["phrase"].isin(*BASE))
    ids = F.flatten(F.transform("expressions", lambda e: e["ids"]))
    named = F.array_union(F.transform("places", lambda p: p["label"]), F.transform(ids, _label_column))
    weight = F.size("places") + 2 * F.size(F.filter("expressions", lambda e: e["valid"]))
    starts = F.transform("base", lambda p: p["word"])
    return (
        scan.withColumn("base", base)
        .withColumn("named", F.array_sort(F.array_distinct(named)))
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), ",").alias("base_labels"),
            F.array_join("named", ",").alias("labels"),
            (1 - F.pow(F.lit(0.4), weight)).alias("score"),
            F.size("expressions").cast("long").alias("n_tags"),
        )
    )


def _label_column(identifier: Column) -> Column:
    """The name with its major version, as ``gpl-3`` for ``gpl-3.0-or-later``."""
    return F.regexp_replace(identifier, r"^(.*?-\d+)(\.\d+)*(-only|-or-later|\+)?$", "$1")
