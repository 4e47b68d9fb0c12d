"""Sequence similarity of two strings, Arrow-batched because no built-in gives this ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """2 * matched characters / total characters, first argument first (the order matters); null if either is.

    A pair that occurs many times in a batch is compared once.
    """
    for left, right in pairs:
        known: dict[tuple[str | None, str | None], float | None] = {}
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = None if None in pair else SequenceMatcher(None, *pair).ratio()
        yield pd.Series([known[pair] for pair in zip(left, right)], dtype="float64")


# keeps the optimizer from pushing a filter on the ratio below a distinct and computing it twice
sequence_ratio = sequence_ratio.asNondeterministic()


def length_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(
        F.try_divide(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))), F.lit(0.0)
    )


def string_features(mention: Column, candidate: Column) -> Column:
    """Ratio, length ratio and exact flag of a mention and a candidate name."""
    m, c = F.lower(F.trim(mention)), F.lower(F.trim(candidate))
    return F.struct(
        sequence_ratio(m, c).alias("ratio"),
        length_ratio(mention, candidate).alias("length_ratio"),
        F.when(m == c, 1.0).otherwise(0.0).alias("exact"),
    )


def char_tokens(df: DataFrame, col: str) -> DataFrame:
    """Rows ``col, token``: the characters of each text, told apart by a running number ('aba': a1, b1, a2).

    The tokens two texts share number as many as their characters do, repeats included.
    """
    counted = (
        df.select(col, F.explode(F.split(col, "")).alias("_c")).where(F.col("_c") != "")
        .groupBy(col, "_c").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    )
    return counted.select(col, "_c", F.explode(F.sequence(F.lit(1), "_n")).alias("_i")).select(
        col, F.concat("_c", F.col("_i").cast("string")).alias("token")
    )
