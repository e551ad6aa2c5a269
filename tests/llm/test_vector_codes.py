"""Operator 11: codes by integer Walsh-Hadamard distances, against plain integers and the SQL twin."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from retentia.llm import queries as Q
from retentia.llm import vector_codes as vc

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract, in Python's integers: rows of (id, vector, label) to {row number: (code, error, label_error)} and digest."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for _, r in kept) // parts)
    ints = {i: [math.floor(Fraction(x) * scale) for x in r[1]] + [0] * (width * parts - len(r[1])) for i, r in kept}
    order = sorted(kept, key=lambda k: (k[1][0] is None, k[1][0] or 0, k[1][1]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(ints[i], p) for i, _ in order] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        for p in range(parts):
            at = {}
            for v in ints.values():
                at.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, vs in at.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    found = {}
    for i, v in ints.items():
        hits = [nearest(cut(v, p), books[p]) for p in range(parts)]
        found[i] = ("".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits))
    label = {}
    for i, r in kept:
        label[r[2]] = label.get(r[2], 0) + found[i][1]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    fine = lambda la: all(fits(found[i][1]) is not None for i, r in kept if r[2] == la)
    return [(rows[i][0], c, fits(e), fits(label[rows[i][2]]) if fine(rows[i][2]) else None) for i, (c, e) in found.items()], digest


def check(spark, rows, **fit):
    want, digest = by_hand(rows, **fit)
    got = vc.compress(spark.createDataFrame(rows, SCHEMA), **fit).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {digest}


def vectors(seed, n, width, labels=3):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.2) for _ in range(width)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 16])
def test_walsh_distances_are_scaled_squares_in_sequency_order(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-999, 999, (20, width)), rng.integers(-999, 999, (30, width))
    p = vc.walsh(a).shape[1]
    d = vc.walsh(a)[:, None] - vc.walsh(b)[None]
    assert ((d * d).sum(axis=2) == p * ((a[:, None] - b[None]) ** 2).sum(axis=2)).all()
    changes = [int((np.diff(f) != 0).sum()) for f in vc.walsh(np.eye(p, dtype=np.int64)).T]
    assert changes == list(range(p))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_is_exact_with_ties_to_the_smaller_index(kind):
    rng = np.random.default_rng(3)
    for spread in (2, 1000):
        a, b = rng.integers(-spread, spread, (300, 6)), rng.integers(-spread, spread, (70, 6))
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        index, total = vc.nearest(vc.walsh(a.astype(kind)), vc.walsh(b.astype(kind)))
        assert (index == d.argmin(axis=1)).all() and (total == 8 * d.min(axis=1)).all()


@pytest.mark.parametrize("total", [0, 1, -1, 2 ** 40, -2 ** 40, -2 ** 40 - 1, 2 ** 200 + 12345, -2 ** 200 + 7])
def test_pieces_add_up(total):
    assert sum(x << (vc.LIMB * k) for k, x in enumerate(vc.pieces(total))) == total


def test_equal_to_plain_integers(spark):
    check(spark, vectors(1, 400, 8), entries=16)
    check(spark, vectors(2, 60, 6), rounds=2)  # fewer rows than entries, parts of uneven width


def test_nulls_repeats_lengths_and_large_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 40, 8) + [
        (1, [0.5] * 8, None), (1, [0.5] * 8, None), (1, [0.25] * 8, 2), (None, [0.1] * 8, 2), (None, [-0.1] * 8, None),
        (90, None, 1), (91, [0.1, None] * 4, 1), (92, [nan] * 8, 1), (93, [0.1] * 7 + [inf], 1),
        (94, [0.2] * 3, 0), (95, [], 0), (96, [1e9, -3e8] * 4, 1), (-5, [5e-324, -5e-324] * 4, 1)]
    check(spark, rows, entries=8)
    check(spark, [*rows, (97, [1e300, -1.7e308] * 4, 2)], entries=8)
    check(spark, [(k, [], 1) for k in range(3)])


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, v, la, k) for k, v, la in vectors(5, 20, 8)], "vec_id long, _v array<double>, code int, id long")
    plain = vc.compress(spark.createDataFrame(vectors(5, 20, 8), SCHEMA)).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(vc.compress(df, vector="_v", label="code").select("vec_id", "code", "error", "label_error").collect()) == sorted(plain)
    empty = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert vc.Codebooks.fit(empty) is None and vc.compress(empty).collect() == []
    assert vc.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_decoding_gives_the_entries(spark):
    df = spark.createDataFrame(vectors(6, 50, 8), SCHEMA)
    books = vc.Codebooks.fit(df, entries=50, rounds=0)
    for r in vc.decode(vc.encode(df, books), books).collect():  # every vector is an entry of its own
        assert r.error == 0 and r.decoded == [math.floor(1024 * x) / 1024 for x in r.embedding]


def test_query_equals_its_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    twin = con.execute(Q.ORACLES["op11_vector_codes"])
    names = [c[0] for c in twin.description]
    got = Q.QUERIES["op11_vector_codes"](spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(twin.fetchall())
