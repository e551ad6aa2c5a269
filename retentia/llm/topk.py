"""Exact top-k by inner product with M-trees (operator 4).

The largest inner product becomes the nearest neighbour in a metric space: a vector v gets the extra coordinate
sqrt(M - |v|^2), M being the largest squared norm of all, a query the extra coordinate 0; then the squared distance
is |q|^2 + M - 2 q.v.

Every row goes to its nearest pivot (pivots are fitted on a bounded sample; the index holds every row), a pivot's rows
are dealt into subtrees of a bounded size, and each subtree becomes the pages of an M-tree: a routing object, a
covering radius, and for each entry its distance to the routing object.  A query starts with a bound, its k-th best
score in the sample, skips the pivots whose ball cannot reach it, and searches the others' subtrees best first.  The
triangle inequality on the stored distances drops an entry before its own distance is computed; scores are exact
integer products.  A block of queries meets a subtree in one task; at the end each query keeps its k best.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no part, neither as a
query nor as a candidate; a vector of zeros does; vectors of other lengths than the query's are no candidates; rows
that share the query's id are not its candidates; equal scores go to the smaller id, and rows that are equal in id
and vector count once each; a query with fewer candidates than k gets them all; an empty table gives an empty
result; other columns are left behind.  Products are exact while sums stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import columns_of, cut_lineage, map_groups
from retentia.llm.vectors import matrix, usable

#: Rows that the pivots and the first bounds are fitted on, pivots, rows of a subtree, queries of a block.
FIT_ROWS, PIVOTS, SUBTREE_ROWS, QUERY_BLOCK = 2048, 64, 4096, 1024
#: Entries of an inner page and of a leaf.
FANOUT, LEAF = 32, 512


def augment(v: np.ndarray, m: float) -> np.ndarray:
    """The vectors with their extra coordinate."""
    return np.concatenate([v, np.sqrt(np.maximum(m - np.einsum("ij,ij->i", v, v), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From the point ``a`` to each row of ``b``."""
    d = b - a
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def farthest_first(points: np.ndarray, n: int) -> list[int]:
    """Rows that lie far from each other: each is the farthest from those before it; no two are equal."""
    chosen, far = [0], distances(points[0], points)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points[chosen[-1]], points))
    return chosen


@dataclass
class Page:
    """A node: its routing object, the radius of all below it, and its entries with their distances to that object."""

    center: np.ndarray
    radius: float
    leaf: bool
    entries: np.ndarray  # numbers of pages, or rows of the leaf's points
    to_center: np.ndarray


def build(points: np.ndarray) -> list[Page]:
    """The pages of an M-tree over ``points``; the first is the root.  Entries of a leaf are rows of ``points``."""
    pages: list[Page] = []

    def grow(rows: np.ndarray, center: np.ndarray) -> int:
        to_center = distances(center, points[rows])
        number = len(pages)
        pages.append(Page(center, float(to_center.max()), True, rows, to_center))
        if len(rows) <= LEAF:
            return number
        seeds = rows[farthest_first(points[rows], FANOUT)]
        if len(seeds) == 1:  # all are equal
            groups = np.array_split(rows, min(FANOUT, -(-len(rows) // LEAF)))
            seeds = [g[0] for g in groups]
        else:
            near = np.argmin(np.stack([distances(points[s], points[rows]) for s in seeds]), axis=0)
            groups = [rows[near == k] for k in range(len(seeds))]
        children = [grow(g, points[s]) for g, s in zip(groups, seeds)]
        page = pages[number]
        page.leaf, page.entries = False, np.array(children)
        page.to_center = distances(center, np.stack([pages[c].center for c in children]))
        return number

    grow(np.arange(len(points)), points[0])
    return pages


class Tree:
    """A subtree read back from its pages."""

    def __init__(self, pages: list[Page], ids: np.ndarray, vectors: np.ndarray, m: float) -> None:
        self.pages, self.ids, self.vectors, self.m = pages, ids, vectors, m
        self.centers = np.stack([p.center for p in pages])
        self.radii = np.array([p.radius for p in pages])

    def search(self, query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[int, int]]:
        """(score, id) of the best ``k`` candidates, of those that score ``bound`` or more; best first."""
        q = np.append(query, 0.0)
        base = float(query @ query) + self.m
        slack = 1e-7 * (base + 1)

        def most(nearest: np.ndarray) -> np.ndarray:
            """The highest score at a distance of ``nearest`` or more."""
            return (base - np.square(np.maximum(nearest, 0))) / 2 + slack

        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        start = float(distances(q, self.centers[:1])[0])
        heap = [(-float(most(np.array([start - self.radii[0]]))[0]), 0, start)]
        while heap:
            high, number, to_query = heapq.heappop(heap)
            if -high < bound:
                break
            page = self.pages[number]
            apart = np.abs(to_query - page.to_center)
            if page.leaf:
                rows = page.entries[most(apart) >= bound]
                scores, ids = np.rint(self.vectors[rows] @ query).astype(np.int64), self.ids[rows]
                kept = (scores >= bound) & (ids != own)
                for score, i in zip(scores[kept].tolist(), ids[kept].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    bound = max(bound, best[0][0])
                continue
            children = page.entries[most(apart - self.radii[page.entries]) >= bound]
            if len(children):
                far = distances(q, self.centers[children])
                reach = most(far - self.radii[children])
                for c, d, u in zip(children.tolist(), far.tolist(), reach.tolist()):
                    if u >= bound:
                        heapq.heappush(heap, (-u, c, d))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


PAGES = "center array<double>, radius double, leaf boolean, entries array<int>, to_center array<double>, ids array<bigint>, points array<double>"


def _build_group(m: float):
    def run(cols: dict, lo: int, hi: int) -> list[tuple]:
        v = matrix(cols["v"], np.arange(lo, hi))
        ids = cols["id"][lo:hi]
        out = []
        for number, p in enumerate(build(augment(v, m))):
            own = p.entries if p.leaf else np.zeros(0, np.int64)
            out.append((cols["pivot"][lo], cols["salt"][lo], number, p.center, p.radius, p.leaf,
                        np.zeros(0, np.int32) if p.leaf else p.entries, p.to_center, ids[own], v[own].ravel()))
        return out
    return run


def _search_group(m: float, k: int):
    def run(cols: dict, lo: int, hi: int) -> list[tuple]:
        is_query = cols["number"][lo:hi] < 0
        pages, ids, vectors, at = [], [], [], 0
        for r in (lo + np.flatnonzero(~is_query)).tolist():
            own = cols["ids"].of(r)
            leaf = bool(cols["leaf"][r])
            pages.append(Page(cols["center"].of(r), float(cols["radius"][r]), leaf, np.arange(at, at + len(own)) if leaf else cols["entries"].of(r), cols["to_center"].of(r)))
            at += len(own)
            ids.append(own)
            vectors.append(cols["points"].of(r).reshape(len(own), -1) if len(own) else np.zeros((0, len(cols["center"].of(r)) - 1)))
        queries = (lo + np.flatnonzero(is_query)).tolist()
        if not pages or not queries:
            return []
        tree = Tree(pages, np.concatenate(ids), np.concatenate(vectors), m)
        return [(cols["query_id"][r], i, s) for r in queries
                for s, i in tree.search(cols["points"].of(r), int(cols["query_id"][r]), k, float(cols["radius"][r]))]
    return run


def _of_width(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best of each query in each subtree that can hold one; all vectors have one length."""
    rows = rows.filter(F.size("v") == width)
    n, m = rows.select(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    m = float(m)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    drawn = rows.filter(draw * n <= FIT_ROWS).select("id", "v").orderBy("id").limit(2 * FIT_ROWS).collect()
    drawn = drawn or rows.select("id", "v").orderBy("id").limit(1).collect()
    sample_ids, sample = np.array([r.id for r in drawn], np.int64), np.array([r.v for r in drawn], np.float64)
    points = augment(sample, m)
    pivots = points[farthest_first(points, max(1, min(PIVOTS, n // SUBTREE_ROWS)))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.stack([distances(p, augment(matrix(columns_of(batch)["v"]), m)) for p in pivots])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=0).astype(np.int32)), pa.array(far.min(axis=0))],
                                                 names=["id", "v", "pivot", "far"])

    placed = cut_lineage(rows.select("id", "v").mapInArrow(assign, "id long, v array<double>, pivot int, far double"))
    balls = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # one row a pivot
    salts, radii = np.zeros(len(pivots), np.int64), np.full(len(pivots), -1.0)
    for b in balls:
        salts[b.pivot], radii[b.pivot] = -(-b.n // SUBTREE_ROWS), b.far
    salt_of = F.element_at(F.array(*[F.lit(max(1, int(s))) for s in salts]), F.col("pivot") + 1)
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), salt_of).cast("int")).drop("far")
    pages = map_groups(salted, ["pivot", "salt"], ["id"], _build_group(m), f"pivot int, salt int, number int, {PAGES}")

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's first bound and the pivots that can reach it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns_of(batch)
            q, ids = matrix(cols["v"]), cols["id"]
            bounds, reach = [], []
            for row, own in zip(q, ids):
                score = np.sort(np.rint(sample[sample_ids != own] @ row))[::-1]
                bound = float(score[k - 1]) if len(score) >= k else -1e300
                base = float(row @ row) + m
                near = np.maximum(distances(np.append(row, 0.0), pivots) - radii, 0)
                bounds.append(bound)
                reach.append(np.flatnonzero((radii >= 0) & ((base - near * near) / 2 + 1e-7 * (base + 1) >= bound)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds), pa.array(reach, pa.list_(pa.int32()))], names=["id", "v", "bound", "pivots"])

    queries = rows.filter("is_query").select("id", "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    aimed = (queries.mapInArrow(aim, "id long, v array<double>, bound double, pivots array<int>")
             .select("*", F.explode("pivots").alias("pivot"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), (salt_of - 1).cast("int")))))
    asked = aimed.select("pivot", "salt", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("number"),
                         F.col("id").alias("query_id"), F.col("bound").alias("radius"), F.col("v").alias("points"))
    stored = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = stored.unionByName(asked, allowMissingColumns=True).withColumns({"query_id": F.coalesce("query_id", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(False))})
    return map_groups(met, ["pivot", "salt", "block"], ["number"], _search_group(m, k), "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` rows with the highest inner products for each query row.

    The components of ``vector`` are whole numbers.
    """
    rows = cut_lineage(df.filter(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .filter("id IS NOT NULL"))
    found = None
    for (width,) in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        part = _of_width(rows, width, k)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.col("id").alias("score")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vec_id").alias(key), "score"))
