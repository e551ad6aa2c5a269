"""Operators on whole tables: n-gram join, substring dedup, mixing, vectors, components; and the pipeline."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import components, embed_dedup, mixing, ngram_join, substring, topk
from retentia.llm import queries as Q

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(k, k + 1) for k in range(200)], [(500, k) for k in range(100)],
    [(random.Random(4).randrange(10 ** 9) % 97, k) for k in range(60)]])
def test_components(spark, links):
    want = union_find({x for link in links for x in link}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in linked}


def jaccard_brute_force(docs):
    sets, links = [], []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links.append((docs[i][0], docs[j][0]))
    root = union_find([d for d, _ in docs], links)
    count = collections.Counter(x for link in links for x in link)
    return {d: (count[d], root[d], root[d] == d) for d, _ in docs}


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MAX_HASHES


def test_op1_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in Q.op1_ngram_jaccard_join(spark, MEDIUM).collect()}
    assert got == jaccard_brute_force(docs)


def near_copies(n, words=60, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"x{k}"
        if k % 5 == 0:
            w[rng.randrange(words)] = f"y{k}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("tile", [512, 16])
def test_jaccard_join_large_group_in_tiles(spark, tile):
    docs = near_copies(90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in ngram_join.jaccard_join(df, tile_classes=tile).collect()}
    assert got == jaccard_brute_force(docs)


def test_jaccard_join_cases(spark):
    long = " ".join(f"v{k % 977}" for k in range(30_000))
    rows = [(9, None), (8, ""), (7, "  "), (1, "A b"), (2, "a  B"), (3, "a b c"), (4, long), (5, long + " end"), (6, "x y z q r s"), (6, "x y z q r s")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_links int, kept string")
    got = sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in ngram_join.jaccard_join(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
                   (6, 1, 6, True), (6, 1, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_of_rows_without_an_id_or_with_a_shared_one(spark):
    near = [t for _, t in near_copies(12, 200, seed=5)]
    other = [t for _, t in near_copies(6, 200, seed=6)]
    ids = [None, None, 5, 1, 1, 7, None, 1, 9, 9, 1, 3]
    rows = [*zip(ids, near), (1, other[0]), (2, other[1]), (None, other[2]), (None, other[2]), (4, "alone here"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_brute_force(list(enumerate(t for _, t in rows)))
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[want[k][1]].append(i)
    low = {root: min((i for i in group if i is not None), default=None) for root, group in groups.items()}
    got = ngram_join.jaccard_join(df).collect()
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=key) == sorted(
        ((i, want[k][0], low[want[k][1]]) for k, (i, _) in enumerate(rows)), key=key)
    assert sorted(((r.doc_id, r.component_id) for r in got if r.kept), key=key) == sorted(
        [(1, 1), (1, 1), (4, 4), (4, 4), (None, None)], key=key)  # one of each group, and the three that have no link


def test_common_counts_either_way():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 80)) for _ in range(40)]
    rows = list(range(40))
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    few = np.zeros((40, 40), bool)
    few[3, 5] = few[7, 1] = True
    assert (ngram_join.common_counts(sets, few, rows, rows) == np.where(few, want, 0)).all()
    assert (ngram_join.common_counts(sets, np.ones((40, 40), bool), rows, rows) == want).all()


def test_chunks_of_a_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    texts = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet' limit 60").fetchall()]
    row, place, digest = substring.digests(pa.array([*texts, None, ""]))
    for k, t in enumerate(texts):
        _, p, d = substring.digests(pa.array([t]))
        assert (digest[row == k] == d).all() and (place[row == k] == p).all()
    for t in texts[:20]:  # chunks cover the text
        raw = np.frombuffer(t.encode(), np.uint8)
        cuts, _ = substring.chunk_starts(raw, np.zeros(1, np.int64))
        assert cuts[0] == 0 and np.diff(np.append(cuts, len(raw))).max() <= substring.MAX_CHUNK + 3


def test_insertion_moves_few_chunks():
    import pyarrow as pa

    text = duckdb.sql(f"select text from '{SMALL}/documents.parquet' order by length(text) desc limit 1").fetchall()[0][0]
    a = set(substring.digests(pa.array([text]))[2].tolist())
    b = set(substring.digests(pa.array(["An insertion. " + text[:2000] + " and another one " + text[2000:]]))[2].tolist())
    assert len(a - b) <= 6


def test_substring_dedup_finds_passages(spark):
    rng = random.Random(7)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(40)}" for _ in range(40_000)]
    take = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [take(60) for _ in range(150)]
    rows, has = [], collections.defaultdict(list)
    for k in range(400):
        parts = [take(40)]
        if k < 300:
            parts += [passages[k % 150], take(30)]
            has[k % 150].append(k)
        rows.append((k, " ".join(parts)))
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum(got[d].repeated_words > 0 for d in ds) for ds in has.values()]
    assert sum(found) >= 0.97 * 300
    assert all(got[k].removed_words == 0 and got[k].text == rows[k][1] for k in range(300, 400))  # clean ones stay
    for p, (first, second) in has.items():
        assert got[first].text == rows[first][1]
        if got[second].removed_words:
            span, = got[second].removed_spans
            raw = rows[second][1].encode()
            assert raw[span.start:span.end].decode().strip() in passages[p]
            assert got[second].text == (raw[:span.start] + raw[span.end:]).decode()


def test_substring_dedup_cases(spark):
    p = " ".join(f"word{k * 7919 % 1009}" for k in range(80))
    long = "é" * 5000
    rows = [(1, None), (2, ""), (3, p), (4, p), (4, p), (5, f"{p} middle {p}"), (None, p), (6, long), (7, long), (8, "a " * 4000)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, removed_words int, place string")
    out = substring.dedup(df)
    assert out.columns[:4] == df.columns and "_removed_words" in out.columns
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r["_removed_words"]))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[3] == [(p, 0)] and got[None] == [(p, 0)]
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0][1] >= 60
    assert got[5][0][1] >= 120
    assert got[6] == [(long, 0)]  # one long word is no passage
    assert got[8][0][1] > 3000
    assert out.count() == len(rows) and substring.dedup(df.limit(0)).count() == 0


def test_substring_dedup_of_two_texts_under_one_id(spark):
    rng = random.Random(21)
    take = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    passage, clean = take(90), take(90)
    rows = [(1, f"{take(30)} {passage}"), (2, f"{take(30)} {passage} {take(20)}"), (2, clean), (3, take(80)), (2, clean)]
    got = sorted((r.doc_id, r.text, r.removed_words) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    taken = [g for g in got if g[2]]
    assert [g[0] for g in taken] == [2] and taken[0][2] >= 70 and passage not in taken[0][1]
    assert sorted(g[:2] for g in got if not g[2]) == sorted(r for r in rows if r != rows[1])


def test_frequent_digests_are_dealt_and_change_nothing(spark, monkeypatch):
    rng = random.Random(22)
    take = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    passage = take(60)
    df = spark.createDataFrame([(k, f"{take(20)} {passage} {take(20)}") for k in range(120)], "doc_id long, text string")
    rows = []
    for frequent in (substring.FREQUENT, 1):  # nearly all repeated digests are frequent; none is
        monkeypatch.setattr(substring, "FREQUENT", frequent)
        rows.append(sorted((r.doc_id, r.text, r.repeated_words) for r in substring.dedup(df).collect()))
    assert rows[0] == rows[1] and sum(passage in t for _, t, _ in rows[0]) == 1


def test_substring_dedup_without_white_space(spark):
    rng = random.Random(11)
    for first, last, n in ((0x4E00, 0x9FA5, 400), (0x0E01, 0x0E2E, 400), (0x61, 0x7A, 1200)):  # Chinese, Thai, encoded: 200 words
        take = lambda n: "".join(chr(rng.randint(first, last)) for _ in range(n))  # noqa: E731, B023
        rows, shared = [], [take(n) for _ in range(20)]
        for k in range(60):
            middle = shared[k % 20] if k < 40 else take(n)
            if 20 <= k < 40:
                middle = middle[:n // 2] + take(1) + middle[n // 2:]  # an insertion moves all that follows
            rows.append((k, take(rng.randint(60, 200)) + middle + take(100)))
        got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[k].text == rows[k][1] and not got[k].removed_words for k in [*range(20), *range(40, 60)])
        gone = [len(rows[k][1]) - len(got[k].text) for k in range(20, 40)]
        assert sum(g > n / 2 for g in gone) >= 19 and sum(gone) > 0.7 * 20 * n
        for k in range(20, 40):
            raw = rows[k][1].encode()
            assert all(raw[s.start:s.end].decode() in shared[k - 20] for s in got[k].removed_spans)
            assert got[k].repeated_words >= got[k].removed_words > 0


def test_targets_stay_under_their_caps_and_use_the_share(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 30):
        rows = [(f"s{k:02d}" if k else None, 5, rng.choice([0, 3, 50, 1000])) for k in range(n)]
        got = {r["_source"]: r["_target"] for r in mixing.targets(spark.createDataFrame(rows, "_source string, _n long, _total long")).collect()}
        total = sum(r[2] for r in rows)
        assert abs(sum(got.values()) - 1.5 * total) < 1e-6 * max(1, total)
        weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate([*sorted(r[0] for r in rows if r[0]), *[None] * any(r[0] is None for r in rows)])}
        open_levels = {round(got[s] / weight[s], 6) for s, _, t in rows if got[s] < 2 * t - 1e-9}
        assert len(open_levels) <= 1  # all that are not full have the same level
        assert all(got[s] <= 2 * t + 1e-9 for s, _, t in rows)


def test_mix_cases(spark):
    rows = [(k, "a", 10, "x") for k in range(50)] + [(k + 50, None, 3, "x") for k in range(7)] + [(99, "b", 0, "x"), (7, "a", 10, "x"), (7, "a", 10, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, epochs string")
    one, two = ([tuple(r) for r in mixing.mix(df, key=["doc_id"]).orderBy("doc_id", "taken").collect()] for _ in range(2))
    assert one == two and len(one) == len(rows)
    for source in ("a", None, "b"):
        own = [r for r in one if r[1] == source]
        assert sum(r[6] for r in own) == int(own[0][5]) and all(0 <= r[6] <= 2 * r[2] for r in own)
    assert mixing.mix(df.limit(0), key=["doc_id"]).count() == 0
    clashing = df.withColumns({"Taken": F.lit("t"), "_source": F.lit("s"), "_key": F.lit("k"), "_bucket": F.lit("b"), "target": F.lit("g"), "_row": F.lit("r"), "a.b": F.lit("d")})
    got = mixing.mix(clashing, key=["doc_id"])
    assert got.columns == [*clashing.columns, "source_size", "_target", "_taken"]
    assert {tuple(r) for r in got.select("Taken", "_source", "_key", "_bucket", "target", "_row", "`a.b`").collect()} == {tuple("tskbgrd")}
    assert sorted((r.doc_id, r._taken) for r in got.collect()) == sorted((r[0], r[6]) for r in one)
    texts = spark.createDataFrame([(None,), ("",), (" a b\tc\n",)], "t string").select(mixing.word_count("t").alias("n"))
    assert [r.n for r in texts.collect()] == [0, 0, 2]


def test_op8_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(Q.ORACLES["op8_mix_sources"])
    got = Q.op8_mix_sources(spark, SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op8_keeps_documents_without_an_id(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS doc_id)
                          FROM '{SMALL}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(Q.ORACLES["op8_mix_sources"])
    got = Q.op8_mix_sources(spark, str(tmp_path)).select(*want.columns).collect()
    assert sum(r.doc_id is None for r in got) > 5
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def cosine_brute_force(rows, threshold=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k]
             if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold]
    ids = [i for i, _ in rows]
    root, count = union_find(ids, links), collections.Counter(x for link in links for x in link)
    return sorted((i, count[i], root[i], root[i] == i) for i in ids)


def random_vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    v = centers[rng.integers(0, 12, n)] + rng.choice([0.05, 0.3, 1.0], (n, 1)) * rng.normal(size=(n, width))
    v[n // 2:n // 2 + 10] = v[0]
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


@pytest.mark.parametrize(("width", "tile", "cells"), [(16, 4096, 256), (16, 32, 8), (3, 50, 4)])
def test_near_duplicates_equal_brute_force(spark, width, tile, cells):
    rows = random_vectors(400, width, width)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, tile_rows=tile, cells=cells).collect()))
    assert got == cosine_brute_force(rows)


def test_near_duplicates_of_doubles_are_decided_in_double_precision(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7))
    x[30:] = x[:30] + rng.normal(size=(30, 7)) * 0.3
    # pairs whose cosines lie a little on either side of 0.9, closer than floats can tell
    near = [[np.cos(a), np.sin(a), 0, 0, 0, 0, 0] for a in (0.0, np.arccos(0.9) - 1e-10, -np.arccos(0.9) - 1e-10)]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate([*x.tolist(), *near])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == cosine_brute_force(rows)


def test_near_duplicate_cases(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.9, 0.4375])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, kept int")
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == cosine_brute_force(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = df.filter("vec_id = 7").union(df.filter("vec_id = 7"))
    assert [tuple(r) for r in embed_dedup.near_duplicates(twice).collect()] == [(7, 1, 7, True)] * 2


def test_op10_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op10_embedding_near_dedup(spark, SMALL).collect())) == cosine_brute_force(rows)


def best_brute_force(rows, is_query, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if is_query(q):
            found = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_tree_search_equals_brute_force():
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (700, 6)).astype(np.float64)
    v[100:300] = v[0]  # many equal ones
    m = float((v * v).sum(axis=1).max())
    pages = topk.build(topk.augment(v, m))
    tree = topk.Tree(pages, np.arange(700), v, m)
    for page in pages:  # radii cover, and the stored distances are right
        below = v[page.entries] if page.leaf else tree.centers[page.entries][:, :-1]
        full = topk.augment(below, m) if page.leaf else tree.centers[page.entries]
        assert np.allclose(topk.distances(page.center, full), page.to_center) and (page.to_center <= page.radius + 1e-9).all()
    for q in range(0, 700, 23):
        scores = sorted((-int(v[q] @ v[i]), i) for i in range(700) if i != q)[:10]
        assert tree.search(v[q], q, 10, -1e300) == [(-s, i) for s, i in scores]
        assert tree.search(v[q], q, 10, -scores[4][0]) == [(-s, i) for s, i in scores if -s >= -scores[4][0]][:10]


@pytest.mark.parametrize("subtree", [4096, 60])
def test_top_k_cases(spark, monkeypatch, subtree):
    monkeypatch.setattr(topk, "SUBTREE_ROWS", subtree)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-50, 50, 4)]) for k in range(300)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300, 340)]
    rows += [(400, None), (410, []), (420, [1.0, None, 2.0, 3.0]), (430, [float("nan")] * 4), (440, [0.0] * 4), (450, [1.0, 2.0]), (460, [3.0, 2.0]), (470, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best_brute_force(rows, lambda i: i % 10 == 0, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_op4_equals_brute_force(spark):
    rows = [(r.vec_id, [np.floor(1024 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = Q.op4_exact_top_k(spark, SMALL).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best_brute_force(rows, lambda i: i % 100 == 0, 10)


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it must do with its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, MEDIUM).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == P.COLUMNS
    first = {r.doc_id: r.text for r in kept["language_id"].collect()}
    assert len(first) >= 0.97 * 1000
    root = jaccard_brute_force(sorted(first.items()))
    second = {r.doc_id: r for r in kept["near_duplicates"].collect()}
    assert set(second) == {d for d, x in root.items() if x[2]} and all(second[d].text == first[d] for d in second)
    third = {r.doc_id: r for r in kept["repeated_passages"].collect()}
    assert set(third) <= set(second) and all(len(third[d].text) == third[d].n_chars for d in third)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    mix = kept["source_mix"].collect()
    assert 1.4 < sum(words(r.text) for r in mix) / sum(words(r.text) for r in third.values()) < 1.6
    assert max(collections.Counter(r.doc_id for r in mix).values()) <= 2
    last = kept["tokens"].collect()
    assert len(last) == len(mix) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
