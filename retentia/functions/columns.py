"""Null-, NaN- and zero-safe column helpers shared by every operator.

pandas semantics the operators reproduce:

* comparisons with a missing value are False, then cast to 0 (``flag``);
* ``clip`` keeps a missing value missing (``clip01``), whereas Spark's
  ``greatest``/``least`` skip nulls;
* division by zero never raises (Spark 4 runs in ANSI mode): ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """``Series.clip(lo, hi)``: null stays null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c.cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    )


def clip01(c: str | Column) -> Column:
    return clip(c, 0.0, 1.0)


def cap1(c: str | Column) -> Column:
    """``min(1, x)`` with null kept null (the request-time variant has no floor)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.least(c.cast("double"), F.lit(1.0)))


def flag(cond: Column) -> Column:
    """A 0/1 integer flag; a comparison against null counts as False."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields null instead of raising on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def zero_if_not_finite(c: str | Column) -> Column:
    """null, NaN, +inf and -inf become 0 (pandas ``fillna(0)`` + ``replace([inf,-inf], 0)``)."""
    c = col(c)
    d = c.cast("double")
    bad = c.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0)).otherwise(c)


def nan_to_null(c: str | Column) -> Column:
    """Turn NaN into null on read so that Spark comparisons behave like pandas ones."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# Rounding offset: half up, with the tie point moved from .5 to .5 - 2**-12 of the last kept digit.
# Decimal data lands exactly on .5 midpoints (42.935 / 120 * 0.3 = 0.1073375), where ulp-level noise
# from summation order would decide the direction; no short decimal lands on the binary fraction.
ROUND_OFFSET = 0.5 + 2.0 ** -12


def round6(c: str | Column) -> Column:
    """Round to 6 decimals with plain IEEE arithmetic (bit-identical in DuckDB)."""
    return round_to(c, 6)


def round_to(c: str | Column, digits: int) -> Column:
    """Rounded, or as it is where that cannot be: null, NaN, infinite, or too large to have such decimals (2**53)."""
    c = col(c).cast("double")
    m = float(10 ** digits)
    fits = F.abs(c) * F.lit(m) < F.lit(2.0 ** 53)  # false for NaN, which Spark orders above every number
    return F.when(fits, F.floor(c * F.lit(m) + F.lit(ROUND_OFFSET)) / F.lit(m)).otherwise(c)


def score9(c: str | Column) -> Column:
    """Scores are rounded to 9 decimals before any band edge or threshold.

    Weighted sums such as ``0.4*a + 0.3*b + 0.3*c`` land a few ulps off the
    band edges (0.30000000000000004); this makes edges exact and engine-neutral.
    """
    return round_to(c, 9)
