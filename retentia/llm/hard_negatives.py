"""Hard-negative mining with a multiway hyperplane tree (operator 12).

The index is a GNAT.  A node has split points and deals its rows to the nearest of them; for each split point it
stores, for each sibling's subtree, the range of the distances from the point to all rows of that subtree.  The two
upper levels are fitted on a bounded sample and hold every row; their ranges cover every row.  A region of more rows
than a page is cut into shells by the distance to its split point, and shells that are still too large (equal
distances) into even parts.  A page is the third level: a node over its own rows, whose children are exact leaves.

Inner products become distances by one extra coordinate: sqrt(M - |v|^2) for a row, M being the largest squared norm,
0 for a query; then the squared distance is |q|^2 + M - 2 q.v, and a window of scores is an annulus around the query.
A sibling goes when, for any split point, its stored range does not meet the annulus as seen from that point.  The
annulus' outer radius shrinks with the k-th best score found.  Leaves are decided by the whole-number products.

Anchors first look for their positives (same label, the best scores), then, for each positive, for the best rows of
other labels whose score lies between two shares of the positive's.  Queries are gathered in blocks by the region they
stand in; a page goes only to the blocks that ask for its region, a block's pages are dealt into lanes of a few pages,
and each lane gives back the k best of each query.

Defined cases: rows whose label or vector is null, or whose vector holds a null or non-finite component, take no
part; shorter vectors (an empty one too) are extended by zeros to the longest; rows that share the anchor's id are
neither its positives nor its negatives; other repeated rows count once each; rows without an id are candidates that
come last among equal scores, and no anchors; of several anchor rows with one id the smallest by label and vector
asks; an anchor without positives and a positive without negatives give no row; a window is empty where the positive's
score is below 0; an empty table gives an empty result; other columns are left behind.  Components are whole numbers
and labels whole numbers; products are exact while sums stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import columns_of, cut_lineage, map_groups, small_side
from retentia.llm.vectors import finite, padded

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the upper levels and the first bounds are fitted on; split points of a node; rows of a page and of a leaf.
FIT_ROWS, FANOUT, PAGE_ROWS, LEAF_ROWS = 4096, 32, 4096, 128
#: Queries of a block, pages of a lane and of a slice of a region, shells of a region.
QUERY_BLOCK, LANE_PAGES, SLICE_PAGES, SHELLS = 512, 8, 64, 64
#: What rounding may move a distance, as a share of the largest one.
SLACK = 2e-6
NOWHERE = 1e300


def lifted(v: np.ndarray, m: float) -> np.ndarray:
    """The rows with their extra coordinate."""
    return np.concatenate([v, np.sqrt(np.maximum(m - np.einsum("ij,ij->i", v, v), 0))[:, None]], axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``."""
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(points: np.ndarray, n: int) -> np.ndarray:
    """Numbers of at most ``n`` rows far from each other, chosen greedily among three times as many; no two are equal."""
    step = max(1, len(points) // (3 * n))
    among = np.arange(0, len(points), step)[:3 * n]
    far = apart(points[among], points[among[:1]])[:, 0]
    chosen = [0]
    while len(chosen) < n and far.max() > 0:
        k = int(far.argmax())
        if k in chosen:
            break
        chosen.append(k)
        far = np.minimum(far, apart(points[among], points[among[[k]]])[:, 0])
    return among[chosen]


@dataclass(frozen=True)
class Node:
    """Split points, and for each of them the lowest and highest distance to the rows of each sibling's subtree."""

    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def empty(cls, splits: np.ndarray) -> Node:
        f = len(splits)
        return cls(splits, np.full((f, f), np.inf), np.full((f, f), -np.inf))

    def cover(self, far: np.ndarray, child: np.ndarray) -> None:
        """Widen the ranges by rows with the distances ``far`` to the split points, dealt to ``child``."""
        for c in np.unique(child):
            rows = far[child == c]
            self.low[:, c] = np.minimum(self.low[:, c], rows.min(axis=0))
            self.high[:, c] = np.maximum(self.high[:, c], rows.max(axis=0))

    def meets(self, far: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """For each query and child, whether the ranges of all split points meet the query's annulus.

        From a split point at the distance d a row at the distance x is between |d - x| and d + x from the query.
        """
        out = np.ones(far.shape, bool)
        near, wide = (inner - slack)[:, None], (outer + slack)[:, None]
        for i in range(len(self.splits)):
            d = far[:, i, None]
            out &= (d + self.high[i] >= near) & (d - self.high[i] <= wide) & (self.low[i] - d <= wide)
        return out


@dataclass(frozen=True)
class Tree:
    """The two upper levels: the root and one node below each of its split points; the leaves are numbered regions."""

    root: Node
    nodes: list[Node]
    m: float
    width: int

    def first(self) -> np.ndarray:
        return np.cumsum([0, *[len(n.splits) for n in self.nodes]])

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's child of the root, child of that node, region and distance to the region's split point."""
        top = apart(points, self.root.splits).argmin(axis=1)
        below, far, first = np.zeros(len(points), np.int64), np.zeros(len(points)), self.first()
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            d = apart(points[rows], self.nodes[t].splits)
            below[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
        return top, below, first[top] + below, far

    @classmethod
    def fit(cls, sample: np.ndarray, m: float, regions: int) -> Tree:
        points = lifted(sample, m)
        tops = max(1, min(FANOUT, int(np.ceil(np.sqrt(regions)))))
        root = Node.empty(points[split_points(points, tops)])
        mine = apart(points, root.splits).argmin(axis=1)
        nodes = []
        for t in range(len(root.splits)):
            rows = points[mine == t]
            rows = rows if len(rows) else root.splits[[t]]
            nodes.append(Node.empty(rows[split_points(rows, max(1, min(FANOUT, -(-regions // tops))))]))
        return cls(root, nodes, m, sample.shape[1])

    def covering(self, rows: DataFrame) -> Tree:
        """The tree with the ranges of all rows; a task gives back one row a split point and sibling that it met."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            root, nodes = Node.empty(self.root.splits), [Node.empty(n.splits) for n in self.nodes]
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = lifted(padded(columns_of(batch)["v"], self.width), self.m)
                top, below, _, _ = self.place(points)
                root.cover(apart(points, root.splits), top)
                for t in np.unique(top):
                    nodes[t].cover(apart(points[top == t], nodes[t].splits), below[top == t])
            for number, node in enumerate([root, *nodes]):
                i, j = np.nonzero(node.high >= 0)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), number)), pa.array(i), pa.array(j), pa.array(node.low[i, j]), pa.array(node.high[i, j])],
                                                     names=["node", "i", "j", "low", "high"])

        found = rows.select("v").mapInArrow(run, "node long, i long, j long, low double, high double")
        whole = [Node.empty(self.root.splits), *[Node.empty(n.splits) for n in self.nodes]]
        for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # at most FANOUT^3 rows
            whole[r.node].low[r.i, r.j], whole[r.node].high[r.i, r.j] = r.low, r.high
        return replace(self, root=whole[0], nodes=whole[1:])

    def asked(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> list[np.ndarray]:
        """For each query the regions that its annulus meets; ``q`` has the extra coordinate 0."""
        out: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        first = self.first()
        top = self.root.meets(apart(q, self.root.splits), inner, outer, slack)
        for t, node in enumerate(self.nodes):
            rows = np.flatnonzero(top[:, t])
            if len(rows):
                below = node.meets(apart(q[rows], node.splits), inner[rows], outer[rows], slack[rows])
                for r, hit in zip(rows.tolist(), below):
                    out[r].append(first[t] + np.flatnonzero(hit))
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


@dataclass(frozen=True)
class Rule:
    """What a query looks for: its ``k`` best rows of its own label, or of another label with a score in its window."""

    k: int
    same: bool
    low: int = LOW
    high: int = HIGH

    def fits(self, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray, named: np.ndarray, q: "Queries", rows: np.ndarray) -> np.ndarray:
        """For each row and each of the queries ``rows``, whether it may be among the results."""
        ok = (scores >= q.bound[rows]) & ((ids[:, None] != q.own[rows]) | ~named[:, None])
        ok &= (labels[:, None] == q.label[rows]) == self.same
        if not self.same:  # exact: whole numbers below 2^53, times 100
            whole, given = scores.astype(np.int64) * 100, q.given[rows]
            ok &= (whole >= self.low * given) & (whole <= self.high * given)
        return ok


class Queries:
    """A block of queries inside a task, and the best rows found for each so far."""

    def __init__(self, cols: dict, rows: np.ndarray, width: int, m: float) -> None:
        lists = cols["v"]
        self.v = np.zeros((len(rows), width))
        for n, r in enumerate(rows.tolist()):
            self.v[n, :len(lists.of(r))] = lists.of(r)
        self.own, self.slot, self.label, self.given = (cols[c][rows].astype(np.int64) for c in ("anchor", "slot", "label", "given"))
        self.lifted = np.concatenate([self.v, np.zeros((len(rows), 1))], axis=1)
        self.base = np.einsum("ij,ij->i", self.v, self.v) + m
        self.slack = SLACK * (np.sqrt(self.base) + 1)
        self.bound = np.full(len(rows), -NOWHERE)
        self.query = self.row_id = np.zeros(0, np.int64)
        self.score, self.named = np.zeros(0), np.zeros(0, bool)

    def annuli(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """The inner and outer radius within which a result of each query lies."""
        if rule.same:
            return np.zeros(len(self.v)), np.sqrt(np.maximum(self.base - 2 * self.bound, 0))
        least = np.maximum(self.bound, self.given * (rule.low / 100))
        inner = np.sqrt(np.maximum(self.base - 2 * (self.given * (rule.high / 100)), 0))
        return inner, np.sqrt(np.maximum(self.base - 2 * least, 0))

    def offer(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray, named: np.ndarray, k: int) -> None:
        """Keep the ``k`` best rows of each query: higher scores first, then smaller ids, rows without an id last."""
        query, score = np.append(self.query, query), np.append(self.score, score)
        row_id, named = np.append(self.row_id, row_id), np.append(self.named, named)
        order = np.lexsort((row_id, ~named, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < k]
        full = order[place == k - 1]
        self.query, self.score, self.row_id, self.named = query[place < k], score[kept], row_id[kept], named[kept]
        self.bound[query[place == k - 1]] = score[full]


PAGE = "rows long, kind string, vectors binary, ids array<bigint>, named array<boolean>, labels array<bigint>, splits array<int>, starts array<int>, low array<double>, high array<double>"


def _pack(v: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    top = np.abs(v).max() if v.size else 0
    kind = next((k for k, most in (("<i1", 127), ("<i2", 32767), ("<i4", 2 ** 31 - 1)) if top <= most), "<f8")
    return kind, v.astype(kind).tobytes()


def _build_page(width: int, m: float):
    def run(cols: dict, lo: int, hi: int) -> list[tuple]:
        v = np.zeros((hi - lo, width))
        for n in range(hi - lo):
            one = cols["v"].of(lo + n)
            v[n, :len(one)] = one
        points = lifted(v, m)
        chosen = split_points(points, max(1, min(FANOUT, -(-len(v) // LEAF_ROWS))))
        node = Node.empty(points[chosen])
        far = apart(points, node.splits)
        child = far.argmin(axis=1)
        node.cover(far, child)
        order = np.argsort(child, kind="stable")
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        starts = np.searchsorted(child[order], np.arange(len(chosen) + 1))
        kind, packed = _pack(v[order])
        named = ~cols["nameless"][lo:hi].astype(bool)
        return [(cols["region"][lo], cols["shell"][lo], cols["salt"][lo], len(v), kind, packed, cols["id"][lo:hi][order], named[order],
                 cols["label"][lo:hi][order], place[chosen], starts, node.low.ravel(), node.high.ravel())]
    return run


def _search_lane(rule: Rule, width: int, m: float):
    def run(cols: dict, lo: int, hi: int) -> list[tuple]:
        is_query = cols["rows"][lo:hi] < 0
        pages = (lo + np.flatnonzero(~is_query)).tolist()
        if not pages or not is_query.any():
            return []
        q = Queries(cols, lo + np.flatnonzero(is_query), width, m)
        q.bound = cols["bound"][lo + np.flatnonzero(is_query)].astype(np.float64)
        for r in pages:
            v = np.frombuffer(cols["vectors"][r], cols["kind"][r]).reshape(-1, width).astype(np.float64) if width else np.zeros((int(cols["rows"][r]), 0))
            ids, named, labels = cols["ids"].of(r), cols["named"].of(r).astype(bool), cols["labels"].of(r)
            splits, starts = cols["splits"].of(r), cols["starts"].of(r)
            f = len(splits)
            node = Node(lifted(v[splits], m), cols["low"].of(r).reshape(f, f), cols["high"].of(r).reshape(f, f))
            open_ = node.meets(apart(q.lifted, node.splits), *q.annuli(rule), q.slack)
            found = []
            for c in range(f):
                asks, leaf = np.flatnonzero(open_[:, c]), slice(starts[c], starts[c + 1])
                if not len(asks):
                    continue
                scores = v[leaf] @ q.v[asks].T
                row, at = np.nonzero(rule.fits(scores, labels[leaf], ids[leaf], named[leaf], q, asks))
                found.append((asks[at], scores[row, at], ids[leaf][row], named[leaf][row]))
            if found:
                q.offer(*[np.concatenate(x) for x in zip(*found)], rule.k)
        return [(q.own[i], q.slot[i], x if ok else None, s) for i, x, ok, s in
                zip(q.query.tolist(), q.row_id.tolist(), q.named.tolist(), q.score.astype(np.int64).tolist())]
    return run


class Index:
    """All rows of a table in pages, with the tree above them."""

    def __init__(self, rows: DataFrame, page_rows: int = PAGE_ROWS) -> None:
        """``rows``: id, label, v; ``v`` holds whole numbers as doubles."""
        self.spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        n, m, width = rows.select(F.count("*"), F.max(square), F.max(F.size("v"))).first()
        if not n:
            raise ValueError("no rows to index")
        self.width, self.m = int(width), float(m)
        # some rows, whatever their ids: bounds and split points from any rows are right
        drawn = rows.filter(F.rand(12) * F.lit(float(n)) <= F.lit(float(FIT_ROWS))).limit(2 * FIT_ROWS).collect() or rows.limit(1).collect()
        sample = np.zeros((len(drawn), self.width))
        for k, r in enumerate(drawn):
            sample[k, :len(r.v)] = r.v
        self.sample = sample
        self.sample_ids = np.array([0 if r.id is None else r.id for r in drawn], np.int64)
        self.sample_named = np.array([r.id is not None for r in drawn], bool)
        self.sample_labels = np.array([r.label for r in drawn], np.int64)
        tree = Tree.fit(sample, self.m, max(1, min(FANOUT * FANOUT, 2 * n // page_rows)))
        tree = tree.covering(rows)
        self.tree = tree

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            draws = np.random.default_rng()  # what it draws is kept by the checkpoint
            for batch in batches:
                if batch.num_rows:
                    _, _, region, far = tree.place(lifted(padded(columns_of(batch)["v"], tree.width), tree.m))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far), pa.array(draws.random(batch.num_rows))],
                                                     names=[*batch.schema.names, "region", "far", "draw"])

        given = rows.select(F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("nameless"), "label", "v")
        dealt = cut_lineage(given.mapInArrow(deal, "id long, nameless boolean, label long, v array<double>, region long, far double, draw double"))
        cuts = [k / SHELLS for k in range(1, SHELLS)]
        regions = dealt.groupBy("region").agg(F.count("*").alias("n"), F.percentile_approx("far", cuts, 1000).alias("borders"))
        shells = F.least(F.lit(SHELLS), F.ceil(F.col("n") / page_rows)).cast("int")
        inner = F.when(shells > 1, F.transform(F.sequence(F.lit(1), shells - 1), lambda k: F.element_at("borders", F.ceil(k * SHELLS / shells).cast("int"))))
        borders = regions.select("region", F.coalesce(inner, F.array().cast("array<double>")).alias("borders"))  # at most FANOUT^2 rows
        shelled = dealt.join(F.broadcast(borders), "region").withColumn("shell", F.size(F.filter("borders", lambda b: b < F.col("far")))).drop("borders", "far")
        sizes = shelled.groupBy("region", "shell").agg(F.ceil(F.count("*") / page_rows).cast("int").alias("salts"))  # at most SHELLS x FANOUT^2 rows
        salted = shelled.join(F.broadcast(cut_lineage(sizes)), ["region", "shell"]).withColumn("salt", F.floor(F.col("draw") * F.col("salts")).cast("int")).drop("draw", "salts")
        self.pages = cut_lineage(map_groups(salted, ["region", "shell", "salt"], [], _build_page(self.width, self.m), f"region long, shell int, salt int, {PAGE}"))
        self.directory = self.pages.groupBy("region").agg(F.count("*").alias("pages")).withColumn("slices", F.ceil(F.col("pages") / SLICE_PAGES).cast("int"))

    def search(self, queries: DataFrame, rule: Rule) -> DataFrame:
        """(anchor, slot, place, id, score) of the best rows of each of ``queries``: anchor, slot, label, given, v."""
        tree, width, m = self.tree, self.width, self.m
        sample, ids, named, labels = self.sample, self.sample_ids, self.sample_named, self.sample_labels

        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query's first bound, its own region and the regions that it asks."""
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_BLOCK):
                    part = batch.slice(at, QUERY_BLOCK)
                    q = Queries(columns_of(part), np.arange(part.num_rows), width, m)
                    rows = np.arange(part.num_rows)
                    scores = sample @ q.v.T
                    row, hit = np.nonzero(rule.fits(scores, labels, ids, named, q, rows))
                    q.offer(hit, scores[row, hit], ids[row], named[row], rule.k)
                    asked = tree.asked(q.lifted, *q.annuli(rule), q.slack)
                    home = tree.place(q.lifted)[2]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(q.bound), pa.array(home), pa.array(asked, pa.list_(pa.int64()))],
                                                     names=[*part.schema.names, "bound", "home", "regions"])

        names = "anchor long, slot int, label long, given long, v array<double>"
        aimed = cut_lineage(queries.select("anchor", "slot", "label", "given", "v").mapInArrow(aim, f"{names}, bound double, home long, regions array<long>"))
        # blocks of queries that stand together; a region with many queries has several blocks
        blocks, number, room = [], 0, 0
        for r in sorted(aimed.groupBy("home").count().collect(), key=lambda r: r.home):  # at most FANOUT^2 rows
            if r["count"] > room:
                number, room = number + 1, QUERY_BLOCK
            own = max(1, -(-r["count"] // QUERY_BLOCK))
            blocks.append((r.home, number, own))
            number, room = (number, room - r["count"]) if own == 1 else (number + own, 0)
        if not blocks:
            blocks = [(-1, 0, 1)]
        by_home = F.broadcast(self.spark.createDataFrame(blocks, "home long, first long, own long"))
        placed = (aimed.join(by_home, "home").withColumn("block", F.col("first") + F.pmod(F.xxhash64("anchor"), F.col("own"))).drop("home", "first", "own"))
        asks = cut_lineage(placed.select("block", F.explode("regions").alias("region")).distinct().join(F.broadcast(self.directory), "region"))
        lanes = small_side(asks.groupBy("block").agg(F.ceil(F.sum("pages") / LANE_PAGES).cast("int").alias("lanes")))
        sent = asks.join(lanes, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("region", "slice", "block", "lanes")
        sliced = (self.pages.join(F.broadcast(self.directory), "region").drop("pages")
                  .withColumn("slice", F.pmod(F.xxhash64("shell", "salt"), F.col("slices")).cast("int")).drop("slices"))
        stored = (sliced.join(small_side(sent), ["region", "slice"]).withColumn("lane", F.pmod(F.xxhash64("region", "shell", "salt"), F.col("lanes")).cast("int"))
                  .drop("region", "slice", "shell", "salt", "lanes"))
        asked = (placed.join(lanes, "block").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
                 .drop("regions", "lanes").withColumn("rows", F.lit(-1).cast("long")))
        met = stored.unionByName(asked, allowMissingColumns=True)
        filled = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in {"anchor": "long", "slot": "int", "label": "long", "given": "long", "bound": "double"}.items()}
        found = map_groups(met.withColumns(filled), ["block", "lane"], ["rows"], _search_lane(rule, width, m), "anchor long, slot int, id long, score long")
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rule.k).select("anchor", "slot", "place", "id", "score")


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    The components of ``vector`` and the labels are whole numbers.  ``low`` and ``high`` are percentages of the
    positive's score, both included.
    """
    rows = cut_lineage(df.filter(finite(vector) & F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], names)
    index = Index(rows.select("id", "label", "v"), page_rows)
    anchors = cut_lineage(rows.filter("is_anchor AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("own"))
                          .select(F.col("id").alias("anchor"), F.col("own.label").alias("label"), F.col("own.v").alias("v")))
    first = anchors.select("anchor", F.lit(0).alias("slot"), "label", F.lit(0).cast("long").alias("given"), "v")
    found = index.search(first, Rule(positives, True)).select("anchor", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("given"))
    near = cut_lineage(found)
    second = anchors.join(near, "anchor").filter("given >= 0").select("anchor", "slot", "label", "given", "v")
    hard = index.search(second, Rule(negatives, False, low, high))
    return hard.join(near, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        F.col("given").alias("positive_score"), F.col("score").alias("negative_score"))
