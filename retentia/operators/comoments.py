"""All pairwise co-moments of some columns in one scan (A8-A10): a small matrix a task, merged by pair.

A task adds up its record batches as matrices: for each pair of columns the number of rows that have both, the means
and the centred sums of squares and products over those rows.  Two such matrices merge exactly (the update formulas for
pairwise means), first inside a task, then over the tasks by one grouped sum a pair.  A row costs a few multiplications
inside a matrix product; nothing is exploded, and what is shuffled is one number set a pair and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SCHEMA = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"
#: A variance below this share of the squared mean is what rounding leaves of a constant.
_ROUNDING = 1e-28


def _of_batch(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, mean of i, centred squares of i, centred products) of each pair (i, j), over the rows that have both; NaN is missing."""
    rows, k = x.shape
    if rows and np.isfinite(x.sum()):  # nothing is missing: one count and one mean a column
        low, high = x.min(axis=0), x.max(axis=0)
        mean = np.where(low == high, low, x.mean(axis=0))
        z = x - mean
        product = z.T @ z
        off = z.sum(axis=0)
        return np.full((k, k), float(rows)), np.repeat((mean + off / rows)[:, None], k, 1), np.repeat((product.diagonal() - off * off / rows)[:, None], k, 1), product - np.outer(off, off) / rows
    here = ~np.isnan(x)
    low, high = np.where(here, x, np.inf).min(axis=0, initial=np.inf), np.where(here, x, -np.inf).max(axis=0, initial=-np.inf)
    count = np.maximum(here.sum(axis=0), 1)
    shift = np.where(low == high, np.where(np.isfinite(low), low, 0.0), np.where(here, x, 0.0).sum(axis=0) / count)
    z, m = np.where(here, x - shift, 0.0), here.astype(np.float64)
    n = m.T @ m
    s, square, product = z.T @ m, (z * z).T @ m, z.T @ z
    some = np.maximum(n, 1)
    return n, shift[:, None] + s / some, square - s * s / some, product - s * s.T / some


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    weight = a[0] * b[0] / some
    mean = np.where(b[0] == 0, a[1], np.where(a[0] == 0, b[1], a[1] + gap * b[0] / some))
    return n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight


def comoments(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) of each pair i <= j of ``cols`` by position, or of each with ``target`` as j.

    ``cols`` holds the target.  Rows where either column is null or NaN do not count for a pair; a pair without rows has
    n = 0.  Infinite values give NaN.
    """
    k = len(cols)
    last = cols.index(target) if target is not None else None
    pairs = [(i, last) for i in range(k)] if last is not None else [(i, j) for i in range(k) for j in range(i, k)]
    i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _of_batch(np.zeros((0, k)))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    total = _merge(total, _of_batch(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)))
        n, mean, square, product = total
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v) for v in (n[i, j], mean[i, j], mean[j, i], square[i, j], square[j, i], product[i, j])]],
            names=["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])

    parts = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, _SCHEMA)
    pair = Window.partitionBy("i", "j")  # one row a task
    mean = lambda m: F.try_divide(F.sum(F.col("n") * F.col(m)).over(pair), F.sum("n").over(pair))
    centred = parts.select("*", mean("mx").alias("_x"), mean("my").alias("_y")).select(
        "i", "j", "n", "_x", "_y", (F.col("mx") - F.col("_x")).alias("dx"), (F.col("my") - F.col("_y")).alias("dy"), "cxx", "cyy", "cxy")
    moved = lambda c, a, b: F.coalesce(F.sum(F.col(c) + F.when(F.col("n") > 0, F.col("n") * F.col(a) * F.col(b)).otherwise(0.0)), F.lit(0.0)).alias(c)
    return centred.groupBy("i", "j").agg(F.sum("n").alias("n"), F.first("_x").alias("mx"), F.first("_y").alias("my"),
                                         moved("cxx", "dx", "dx"), moved("cyy", "dy", "dy"), moved("cxy", "dx", "dy"))


def correlation() -> Column:
    """Pearson's correlation of a row of ``comoments``; null without rows or where a column does not vary."""
    varies = lambda c, m: F.col(c) > F.col("n") * F.col(m) * F.col(m) * F.lit(_ROUNDING)
    return F.when((F.col("n") > 0) & varies("cxx", "mx") & varies("cyy", "my"), F.col("cxy") / (F.sqrt("cxx") * F.sqrt("cyy")))
