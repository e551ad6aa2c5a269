"""Reading a column of vectors inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def matrix(lists, rows: np.ndarray | None = None, dtype=np.float64) -> np.ndarray:
    """Rows of a list column whose lists all have the same length, as a matrix."""
    n = len(lists.offsets) - 1
    width = int(lists.offsets[1] - lists.offsets[0]) if n else 0
    full = lists.values[lists.offsets[0]:lists.offsets[-1]].reshape(n, width)
    return np.asarray(full if rows is None else full[rows], dtype)


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components (an empty one has none) are finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ok, F.lit(False))


def padded(lists, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``width`` columns, shorter ones extended by zeros."""
    lengths = np.diff(lists.offsets)
    values = np.asarray(lists.values[lists.offsets[0]:lists.offsets[-1]], np.float64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out
