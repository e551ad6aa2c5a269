"""Pairwise co-moments against numpy: missing values, constants, far-off means, any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators.comoments import _merge, _of_batch, comoments, correlation

SCHEMA = "a double, b double, c double, d double, e double"


def table(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 100, 1e-3, 1, 1] + [0, 1e6, 5, 0, 0]
    x[:, 3] = 7.1  # a constant
    x[:, 1] += 60 * x[:, 0]
    x[rng.random((n, 5)) < 0.2] = np.nan
    x[:, 4] = np.where(rng.random(n) < 0.02, x[:, 4], np.nan)
    return x


def by_hand(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if not both.any() or a.std() < 1e-13 * abs(a.mean()) or b.std() < 1e-13 * abs(b.mean()):
        return both.sum(), None
    return both.sum(), float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_to_numpy(spark, parts):
    x = table(1, 600)
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = comoments(df, df.columns).withColumn("r", correlation()).collect()
    assert len(got) == 15
    for g in got:
        n, r = by_hand(x, g.i, g.j)
        assert g.n == n and (g.r is None) == (r is None), (g, r)
        assert r is None or g.r == pytest.approx(r, abs=1e-9)
    one = comoments(df, df.columns, "b").withColumn("r", correlation()).collect()
    assert {(g.i, g.j) for g in one} == {(k, 1) for k in range(5)}


def test_batches_merge_in_any_way():
    x = table(2, 300)
    whole = _of_batch(x)
    for cuts in ([150], [1, 2, 299], [0, 0, 300], list(range(0, 300, 7))):
        total = _of_batch(np.zeros((0, 5)))
        for part in np.split(x, cuts):
            total = _merge(total, _of_batch(part))
        for a, b in zip(total, whole):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_empty_tables_and_single_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert {(r.n, r.r) for r in comoments(df, df.columns).withColumn("r", correlation()).collect()} <= {(0.0, None)}
    one = spark.createDataFrame([(1.0, 2.0, None, 4.0, 5.0)], SCHEMA)
    assert {r.r for r in comoments(one, one.columns).withColumn("r", correlation()).collect()} == {None}


def test_nothing_is_exploded(spark):
    plan = comoments(spark.range(9).select(*[F.rand(k).alias(c) for k, c in enumerate("abc")]), list("abc"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
