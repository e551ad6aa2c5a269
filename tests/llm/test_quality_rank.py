"""Operator 13: quality by Bradley-Terry preference pairs, against direct computations and held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import quality_rank as qr
from retentia.llm import queries as Q

MEDIUM = "/root/testdata/sf0.01"


def kind(byte):
    c = chr(byte)
    for k, chars in enumerate((" \t\x0b\x0c\r", "\n")):
        if c in chars:
            return k
    if byte >= 128 or "a" <= c <= "z":
        return 2
    return 3 if "A" <= c <= "Z" else 4 if c.isdigit() else 6 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(c) if 33 <= byte < 127 else 5


@pytest.mark.parametrize("text", ["a", "Two words.", "THE!! END&&& über 3,5 ½\n\nx | y\tz\x00", "la " * 1234 + "fin", "ab" * 700 + " 1 2"])
def test_features_by_hand(text):
    codes = [kind(b) for b in text.encode()]
    want = np.zeros((qr.KINDS, qr.KINDS))
    for a, b in zip(codes, codes[1:]):
        want[a, b] += 1
    words = text.split()
    shares = [sum(len(set(words[i:i + n])) for i in range(0, len(words), n)) / len(words) for n in qr.WINDOWS]
    got = qr.features(text)
    assert np.allclose(got[:-4], np.sqrt(want.ravel() / max(1, len(codes) - 1)))
    assert np.allclose(got[-4:], [*shares, math.log1p(sum(map(len, words)) / len(words)), math.log1p(len(words) / (text.count("\n") + 1))])


def test_pieces_change_no_pair(monkeypatch):
    text = "One two; THREE\n" * 50
    whole = qr.features(text)
    monkeypatch.setattr(qr, "PIECE", 15)  # a line: words are not cut
    assert np.allclose(qr.features(text), whole)


@pytest.mark.parametrize("seed", range(3))
def test_weights_minimise_the_pairwise_loss(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(60, 5)) * [1, 5, 0.1, 1, 2], np.ones((60, 1))], axis=1)
    better, worse = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    w = qr.bradley_terry(x, better, worse, ridge=0.1, steps=2000)
    spread = x.std(axis=0)

    def loss(w):
        d = (x[better] - x[worse]) @ w
        return np.log1p(np.exp(-d)).mean() + 0.05 * ((w * spread) ** 2).sum()

    assert w[5] == 0
    for k in range(5):
        for step in (-0.01, 0.01):
            moved = w.copy()
            moved[k] += step / spread[k]
            assert loss(moved) > loss(w)


def test_quantile():
    worth, weight = np.array([3.0, 1.0, 2.0, 10.0]), np.array([1.0, 1.0, 1.0, 7.0])
    assert [qr.quantile(worth, weight, s) for s in (0.1, 0.2, 0.3, 1.0)] == [1.5, 2.5, 6.5, 10.0]


def quality(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return Q.QUERIES["op13_quality_rank"](spark, MEDIUM), docs


def test_held_out_labels(spark):
    got, docs = quality(spark)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    marked = got.join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert marked and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in marked)
    assert sum(r.predicted == r.quality for r in marked) >= 0.97 * len(marked)


def texts(seed, n, bad):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    return [" ".join(word().upper() + "!!" if bad else word() for _ in range(rng.randint(5, 60))) for _ in range(n)]


def table(spark, copies=0):
    rows = [(k, t, 1) for k, t in enumerate(texts(1, 60, False))] + [(100 + k, t, 0) for k, t in enumerate(texts(2, 30, True))]
    rows += [(1000 + k, rows[-1][1], 0) for k in range(copies)]
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))


def test_copies_do_not_push_other_texts_out(spark):
    docs, labels = table(spark, copies=3000)
    model = qr.Model.fit(docs, labels, docs_per_label=200)
    got = qr.score(docs.limit(90), model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.quality for r in got)
    assert (qr.Model.fit(docs, labels, docs_per_label=200).weights == model.weights).all()


def test_labels_that_teach_nothing(spark):
    docs, labels = table(spark)
    for few in (labels.limit(0), labels.filter("quality = 1"), labels.select("doc_id", F.lit(None).cast("int").alias("quality"))):
        model = qr.Model.fit(docs, few)
        assert {(r.score, r.predicted) for r in qr.score(docs, model).collect()} == {(0.5, 1)}
    odd = labels.union(spark.createDataFrame([(None, 1), (1, None), (3, 7), (10 ** 9, 0)], labels.schema))
    assert (qr.Model.fit(docs, odd).weights == qr.Model.fit(docs, labels).weights).all()


def test_nulls_long_texts_and_clashing_columns(spark):
    docs, labels = table(spark)
    model = qr.Model.fit(docs, labels)
    long_text = "fine words here " * 200_000
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, long_text, 3), (3, "\n\t ", 4), (4, "x", None)], "doc_id long, text string, _label int")
    got = qr.score(odd, model).collect()
    assert len(got) == 6 and [r._label for r in sorted(got, key=lambda r: (r._label is None, r._label))] == [1, 2, 2, 3, 4, None]
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1
    assert qr.score(odd.limit(0), model).collect() == []
    named = docs.withColumn("label", F.lit("x")).withColumn("_digest", F.lit(1))
    assert (qr.Model.fit(named, labels.withColumn("text", F.lit("z")).withColumn("rows", F.lit(9))).weights == model.weights).all()


def test_all_pairs_of_all_texts_are_fitted(spark):
    docs, labels = table(spark)
    rows = sorted(docs.join(labels, "doc_id").collect(), key=lambda r: r.doc_id)
    x = np.array([qr.features(r.text).astype(np.float32) for r in rows], np.float64)
    y = np.array([r.quality for r in rows])
    better, worse = (k.ravel() for k in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    want = qr.bradley_terry(x, better, worse, steps=3000)
    model = qr.Model.fit(docs, labels, docs_per_label=2)

    def loss(w):
        return np.log1p(np.exp(-(x[better] - x[worse]) @ w)).mean() + qr.RIDGE / 2 * ((w * x.std(axis=0)) ** 2).sum()

    assert loss(model.weights) < 1.02 * loss(want)
    assert math.isclose(math.log(qr.CUT / (1 - qr.CUT)) - model.bias, qr.quantile(x @ model.weights, np.ones(len(x)), (y == 0).mean()), abs_tol=1e-9)


def test_threshold_of_a_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    worth = np.concatenate([rng.normal(size=3000).round(2), rng.normal(size=3000) * 1e-5, [1e6]])
    rows = rng.integers(1, 5, len(worth))
    df = spark.createDataFrame(list(zip(worth.tolist(), rows.tolist())), "worth double, rows long")
    points, index = np.unique(worth, return_inverse=True)
    weight = np.bincount(index, rows)
    monkeypatch.setattr(qr, "EXACT_WORTHS", 20)
    for share in (0.001, 0.3, 0.5, 0.77, 1.0):
        assert qr.threshold(df, share) == qr.quantile(points, weight, share)
