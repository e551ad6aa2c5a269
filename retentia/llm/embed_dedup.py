"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 10).

Equal vectors form a class and one of each goes on.  The principal axes of all unit vectors (sums of products,
computed over every row) order the dimensions by variance; a vector is kept along those axes together with the norms
of its suffixes.  Vectors are dealt into cells by their leading coordinates and a large cell into tiles; two cells
whose boxes are farther apart than the threshold allows are not compared.  Two tiles meet in one task, which adds up
the products of the leading dimensions first; the rest of a pair's cosine is at most the product of its suffix norms,
and a pair stops as soon as that bound falls short.  What is left is decided by the plain cosine of the vectors as
they are given, in double precision.

A task gives back one row a class (its links there, a root of what it is linked with), never the pairs.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors
of different lengths do not link; equal vectors link with each other; rows that share an id are one vector that
links where any of them does; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import columns_of, cut_lineage, map_groups
from retentia.llm.components import components
from retentia.llm.vectors import matrix, usable

THRESHOLD = 0.9
#: Vectors that a tile is meant to hold; cells of the leading coordinates; rows that the cells' borders are fitted on.
TILE_ROWS, CELLS, FIT_ROWS = 4096, 256, 20_000
#: Dimensions that are added up between two tests of the bound.
STEP = 8
#: What rounding may move a bound or a cosine before the deciding product.
SLACK = 1e-9


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of products of every two dimensions over all unit vectors; only matrices leave the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = matrix(columns_of(batch)["v"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)  # the batch's own numbers stay as they are
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    partial = rows.select("v").mapInArrow(run, "i int, sums array<double>")
    summed = partial.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for r in summed.collect():  # width x width numbers
        out[r.i, r.j] = r.s
    return out


def axes_of(sums: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling variance."""
    value, axes = np.linalg.eigh(sums)
    return np.ascontiguousarray(axes[:, np.argsort(-value, kind="stable")])


def fit_cells(rows: DataFrame, axes: np.ndarray, cells: int, n: int) -> list[tuple[int, float]]:
    """Borders of a binary tree over the leading coordinates, fitted on about ``FIT_ROWS`` rows drawn by hash."""
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sample = np.array([r.v for r in rows.filter(draw * n <= FIT_ROWS).select("rep", "v").orderBy("rep").collect()], np.float64)
    if len(sample) < 2 * cells:
        return []
    y = sample / np.linalg.norm(sample, axis=1, keepdims=True) @ axes
    borders: list[float] = []
    parts = [np.arange(len(y))]
    depth = 0
    while len(parts) < cells:  # all cells of a level are cut along the next axis, at their medians
        nxt = []
        for p in parts:
            border = float(np.median(y[p, depth % y.shape[1]])) if len(p) else 0.0
            borders.append(border)
            nxt += [p[y[p, depth % y.shape[1]] < border], p[y[p, depth % y.shape[1]] >= border]]
        parts, depth = nxt, depth + 1
    return [(len(borders), depth), *enumerate(borders)]


def cells_of(y: np.ndarray, borders: list[tuple[int, float]]) -> np.ndarray:
    """Each row's leaf of the border tree."""
    cell = np.zeros(len(y), np.int64)
    if not borders:
        return cell
    value = np.array([b for _, b in borders[1:]])
    first, width = 0, 1
    for depth in range(int(borders[0][1])):
        cell = cell * 2 + (y[:, depth % y.shape[1]] >= value[first + cell])
        first, width = first + width, width * 2
    return cell


def close_pairs(a: np.ndarray, b: np.ndarray, suffix_a: np.ndarray, suffix_b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product can reach ``threshold``; suffix[:, k] is the norm of the dimensions from k * step on."""
    out_i, out_j = [], []
    for lo in range(0, len(a), 256):
        x = a[lo:lo + 256]
        part = x[:, :step] @ b[:, :step].T
        i, j = np.nonzero(part + suffix_a[lo:lo + 256, 1][:, None] * suffix_b[:, 1][None, :] >= threshold - SLACK)
        part = part[i, j]
        for k in range(1, -(-a.shape[1] // step)):
            if not len(i):
                break
            if len(i) > 0.2 * len(x) * len(b):  # most pairs are still open: a whole product is cheaper
                full = x @ b.T
                keep = full[i, j] >= threshold - SLACK
                i, j = i[keep], j[keep]
                break
            part = part + np.einsum("ij,ij->i", x[i, k * step:(k + 1) * step], b[j, k * step:(k + 1) * step])
            keep = part + suffix_a[lo + i, k + 1] * suffix_b[j, k + 1] >= threshold - SLACK
            i, j, part = i[keep], j[keep], part[keep]
        out_i.append(i + lo)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def suffix_norms(y: np.ndarray, step: int = STEP) -> np.ndarray:
    """Norms of the dimensions from k * step on, for k = 0, 1, ...; the last is 0."""
    squares = np.add.reduceat(y * y, np.arange(0, y.shape[1], step), axis=1)
    tail = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail, np.zeros((len(y), 1))], axis=1))


def _compare(axes: np.ndarray, threshold: float):
    def compare(cols: dict, lo: int, hi: int) -> list[tuple]:
        """(class, its links with others here, root) of each class of two tiles that has a link."""
        side = cols["side"][lo:hi]
        same = cols["ta"][lo] == cols["tb"][lo]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return []
        v = matrix(cols["v"], np.arange(lo, hi))
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        y = (v / norm[:, None]) @ axes
        suffix = suffix_norms(y)
        i, j = close_pairs(y[left], y[right], suffix[left], suffix[right], threshold)
        if same:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        keep = np.concatenate([np.einsum("ij,ij->i", v[i[k:k + 65536]], v[j[k:k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
        keep = keep / (norm[i] * norm[j]) >= threshold
        i, j = i[keep], j[keep]
        if not len(i):
            return []
        copies, rep = cols["copies"][lo:hi].astype(np.int64), cols["rep"][lo:hi]
        links = np.bincount(i, copies[j], len(v)).astype(np.int64) + np.bincount(j, copies[i], len(v)).astype(np.int64)
        root = np.arange(len(v))
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return [(rep[r], links[r], rep[root[r]]) for r in np.flatnonzero(links).tolist()]
    return compare


def _links_of_width(classes: DataFrame, width: int, threshold: float, tile_rows: int, cells: int) -> DataFrame:
    """(rep, links, root) of all vectors of one length."""
    rows = classes.filter(F.size("v") == width)
    n = rows.count()
    axes = axes_of(moments(rows, width))
    borders = fit_cells(rows, axes, min(cells, 1 << max(0, (n // tile_rows)).bit_length()), n)
    kind, number = classes.schema["rep"].dataType.simpleString(), classes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(columns_of(batch)["v"])
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(y, borders).astype(np.int32)), pa.array(list(y), pa.list_(pa.float64()))],
                                                 names=["rep", "copies", "v", "cell", "y"])

    placed = rows.select("rep", "copies", "v").mapInArrow(place, f"rep {kind}, copies long, v {number}, cell int, y array<double>")
    boxes = (placed.select("cell", F.posexplode("y").alias("k", "c")).groupBy("cell", "k")
             .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).collect())  # cells x width numbers
    low, high, size = np.full((cells, width), np.inf), np.full((cells, width), -np.inf), np.zeros(cells, np.int64)
    for r in boxes:
        low[r.cell, r.k], high[r.cell, r.k], size[r.cell] = r.low, r.high, r.n
    used = np.flatnonzero(size)
    tile_count = {int(c): max(1, -(-int(size[c]) // tile_rows)) for c in used}
    reach = 2 - 2 * threshold + 1e-9  # squared distance of two unit vectors at the threshold
    near = []
    for c in used.tolist():
        gap = np.maximum(0, np.maximum(low[c] - high[used], low[used] - high[c]))
        near += [(c, int(d), tile_count[int(d)]) for d in used[(gap * gap).sum(axis=1) <= reach]]
    partners = classes.sparkSession.createDataFrame(near, "cell int, other int, other_tiles int")  # at most cells x cells rows
    counts = classes.sparkSession.createDataFrame([(c, t) for c, t in tile_count.items()], "cell int, tiles int")
    dealt = (placed.drop("y").join(F.broadcast(counts), "cell")
             .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
             .join(F.broadcast(partners), "cell")
             .withColumn("other_tile", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
             # a tile's number, over all cells
             .withColumn("mine", F.col("cell").cast("long") * (1 << 32) + F.col("tile"))
             .withColumn("theirs", F.col("other").cast("long") * (1 << 32) + F.col("other_tile"))
             .select(F.least("mine", "theirs").alias("ta"), F.greatest("mine", "theirs").alias("tb"),
                     F.when(F.col("mine") <= F.col("theirs"), 0).otherwise(1).alias("side"), "rep", "copies", "v"))
    return map_groups(dealt, ["ta", "tb"], [], _compare(axes, threshold), f"rep {kind}, links long, root {kind}")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    tile_rows: int = TILE_ROWS, cells: int = CELLS) -> DataFrame:
    """(key, n_links, component_id, kept) of each row; of a component the smallest id is kept."""
    ok = usable(vector) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(key).alias("id"), F.when(ok, F.col(vector)).alias("v"))
    classes = cut_lineage(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    widths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = None
    for width in sorted(widths):
        part = cut_lineage(_links_of_width(classes, width, threshold, tile_rows, cells))
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "root").withColumnRenamed("id", "rep")
    result = (classes.join(linked, "rep", "left").join(groups, "rep", "left")
              .select(F.col("v").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    return (rows.join(result, F.col("v") == F.col("class"), "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
