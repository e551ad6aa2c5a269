"""Operator 12: hard negatives by a multiway hyperplane tree, against brute force and the SQL twin."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import hard_negatives as hn
from retentia.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, anchor, k=5, n=10, low=30, high=90):
    """Rows of (id, vector, label) to the sorted result, every product computed."""
    kept = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    anchors = {}
    for i, v, la in kept:
        if i is not None and anchor(i):
            anchors[i] = min(anchors.get(i, (la, v)), (la, v))
    out = []
    for a, (la, v) in anchors.items():
        scored = sorted((-int(sum(x * y for x, y in zip(v, w))), i is None, i or 0, lb) for i, w, lb in kept if i != a)
        for s, none, i, _ in [c for c in scored if c[3] == la][:k]:
            hard = [c for c in scored if c[3] != la and low * -s <= 100 * -c[0] <= high * -s][:n]
            out += [(a, None if none else i, r + 1, None if c[1] else c[2], -s, -c[0]) for r, c in enumerate(hard)]
    return sorted(out, key=repr)


def check(spark, rows, every=10, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = hn.mine(df, F.col("vec_id") % every == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = by_hand(rows, lambda i: i % every == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def vectors(seed, n, width=8, labels=3, spread=20, centres=4):
    rng = random.Random(seed)
    mid = [[rng.randint(-spread, spread) for _ in range(width)] for _ in range(centres)]
    return [(k, [float(c + rng.randint(-5, 5)) for c in rng.choice(mid)], rng.randrange(labels)) for k in range(n)]


def test_equal_to_brute_force_in_one_page(spark):
    assert check(spark, vectors(1, 200))


def test_equal_to_brute_force_over_regions_shells_and_lanes(spark):
    rows = vectors(2, 300, labels=2) + [(k, [3.0] * 8, k % 2) for k in range(300, 450)]  # a third are equal vectors
    assert check(spark, rows, every=50, page_rows=16)


def test_nulls_ties_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60, spread=3) + [
        (10, [9.0] * 8, 0), (10, [9.0] * 8, 0), (11, [2.0] * 8, 1), (11, [2.0] * 8, 1), (11, [1.0] * 8, 2),
        (None, [4.0] * 8, 0), (None, [4.0] * 8, 1), (None, [4.0] * 8, 1), (100, None, 1), (110, [1.0] * 8, None),
        (120, [1.0, None] * 4, 1), (130, [nan] * 8, 1), (140, [inf] + [1.0] * 7, 1), (150, [5.0] * 3, 2), (160, [], 1),
        (170, [0.0] * 8, 2), (-180, [-7.0] * 8, 1)]
    assert check(spark, rows)


def test_few_rows_and_empty_tables(spark):
    assert check(spark, [(0, [1.0], 1), (1, [10.0], 1), (2, [9.0], 2), (3, [10.0], 2), (4, [3.0], 2)], every=10)
    assert not check(spark, [(0, [1.0], 1)])
    assert not check(spark, [(0, None, 1)])
    assert not check(spark, [(5, [1.0], 1), (6, [1.0], 2)])


def test_clashing_columns(spark):
    rows = vectors(4, 80)
    df = spark.createDataFrame([(i, v, la, 7, "x", 1.0) for i, v, la in rows], "region long, v array<double>, anchor int, slot int, id string, score double")
    got = hn.mine(df, F.col("region") % 10 == 0, key="region", vector="v", label="anchor").collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("seed", range(5))
def test_no_result_of_an_annulus_is_eliminated(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (8, 6))
    v = (centres[rng.integers(0, 8, 400)] + rng.integers(-4, 4, (400, 6))).astype(float)
    m = float((v * v).sum(axis=1).max())
    points = hn.lifted(v, m)
    node = hn.Node.empty(points[hn.split_points(points, 12)])
    far = hn.apart(points, node.splits)
    child = far.argmin(axis=1)
    node.cover(far, child)
    q = np.concatenate([v[:50], np.zeros((50, 1))], axis=1)
    d = hn.apart(q, points)
    inner, outer = np.quantile(d, 0.02, axis=1), np.quantile(d, 0.05, axis=1)
    meets = node.meets(hn.apart(q, node.splits), inner, outer, np.full(50, 1e-6))
    inside = (d >= inner[:, None]) & (d <= outer[:, None])
    for i, j in zip(*np.nonzero(inside)):
        assert meets[i, child[j]]
    assert not meets.all()


def test_query_equals_its_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    twin = con.execute(Q.ORACLES["op12_hard_negatives"])
    names = [c[0] for c in twin.description]
    got = Q.QUERIES["op12_hard_negatives"](spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(twin.fetchall())
