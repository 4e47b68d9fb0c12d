"""Column helpers: safe ratios, clamps, portable hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num, den, default: float = 0.0) -> Column:
    """num / den, or ``default`` where den is zero or null."""
    return F.coalesce(F.try_divide(num, den), F.lit(default))


def harmonic(p: Column, r: Column) -> Column:
    """F1 of precision and recall, 0 when both are 0."""
    return ratio(2 * p * r, p + r)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def hash60(*parts) -> Column:
    """60-bit non-negative integer from md5 over the parts joined by ':'.

    md5 gives the same value in every engine, so samples can be reproduced outside Spark,
    and no ``rand()`` is involved: a retried task draws the same numbers again.
    """
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Hash of the parts scaled to [0, 1)."""
    return hash60(*parts).cast("double") / F.lit(float(1 << 60))
