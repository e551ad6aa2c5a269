"""Deterministic per-row pseudo-random numbers.

``rand()`` depends on partitioning and changes when an executor is lost and a
task recomputes; a hash of stable keys does not.  The first 13 hex digits of an
MD5 digest, read as a 52-bit number and divided by 2**52 (both exact in a
double), give a uniform value in [0, 1) that DuckDB can reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(*parts: str | Column) -> Column:
    """Uniform [0, 1) from ``md5(p1 || ':' || p2 ...)``; strings are literals, Columns are columns."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)
