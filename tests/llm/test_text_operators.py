"""Operators on single texts: BPE, licences, language ID, LM scores, HTML."""

import collections
import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import bpe, html_text, langid, licences, lm_score
from retentia.llm import queries as Q
from retentia.llm.boosting import Boosted
from retentia.session import checkpoint_dir

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, score string, labels string"


@pytest.fixture(scope="module")
def tokenizer():
    return Q.tokenizer()


@pytest.fixture(scope="module")
def reference_encoder(tokenizer):
    import tiktoken

    data, pattern = tokenizer
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(data), special_tokens={})


@pytest.fixture(scope="module")
def encoder(tokenizer):
    data, pattern = tokenizer
    return bpe.Bpe(bpe.load_ranks(data), pattern)


def odd_texts():
    rng = random.Random(5)
    alphabet = "ab \n\t'sé漢字1!.   "
    out = ["", " ", "  ", "\n", "don't we'll", "a" * 700, "ab" * 400, " x" * 300, "<|endoftext|>", "\x1c a\x85b", "é" * 300]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return out + ["".join(rng.choice("abr") for _ in range(rng.randint(0, 300))) for _ in range(150)]


def test_bpe_equals_reference(encoder, reference_encoder):
    texts = odd_texts()
    got = [np.frombuffer(b, np.int32).tolist() for b in encoder.encode_all(texts)]
    assert got == [reference_encoder.encode_ordinary(t) for t in texts]
    assert all(encoder.decode(g) == t.encode() for g, t in zip(got, texts))


def test_bpe_long_piece_equals_many_pieces(encoder, reference_encoder):
    rng = random.Random(1)
    for _ in range(60):
        s = "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 200)))
        assert encoder.long_piece(s.encode()) == encoder.queue.merge([s.encode()])[0]
    s = "".join(rng.choice("abcdeé") for _ in range(30_000))
    assert encoder.encode(s) == reference_encoder.encode_ordinary(s)


def test_bpe_memo_that_overflows_changes_nothing(encoder, reference_encoder, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    data, pattern = tokenizer
    small = bpe.Bpe(bpe.load_ranks(data), pattern)
    texts = ["one two three " * 3 + "four, five. six", "six five, one seven eight nine ten eleven twelve", "two three"]
    for _ in range(2):
        for t in texts:
            assert small.encode(t) == reference_encoder.encode_ordinary(t)


def test_rank_queue_gives_lowest_rank_leftmost_first():
    rng = random.Random(2)
    entries = [(rng.randrange(50_000), rng.randrange(1000)) for _ in range(500)]
    queue = bpe.RankQueue()
    for rank, at in entries:
        queue.push(rank, at)
    got = []
    while (x := queue.pop()) is not None:
        got.append(x)
    assert got == sorted(entries)


def test_bpe_learns_new_segments_in_portions(reference_encoder, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "LEARN_CHARS", 300)
    data, pattern = tokenizer
    small, cut, sizes = bpe.Bpe(bpe.load_ranks(data), pattern), bpe.Bpe.learn_some, []
    monkeypatch.setattr(bpe.Bpe, "learn_some", lambda self, some, *rest: (sizes.append(sum(map(len, some))), cut(self, some, *rest)))
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeéß.", k=rng.randrange(1, 12))) for _ in range(400)) for _ in range(3)]
    got = [np.frombuffer(b, np.int32).tolist() for b in small.encode_all([*texts, *odd_texts()])]
    assert got == [reference_encoder.encode_ordinary(t) for t in [*texts, *odd_texts()]]
    longest = max(len(t) for t in odd_texts())
    assert len(sizes) > 10 and max(sizes) < 300 + longest and sum(x > 320 for x in sizes) <= len(odd_texts())


def test_bpe_learns_a_fourth_of_a_step_at_a_time(reference_encoder, tokenizer, monkeypatch):
    data, pattern = tokenizer
    cut, sizes = bpe.Bpe.learn_some, []
    monkeypatch.setattr(bpe.Bpe, "learn_some", lambda self, some, *rest: (sizes.append(sum(map(len, some)) + len(some)), cut(self, some, *rest)))
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeéß.", k=rng.randrange(1, 12))) for _ in range(30_000)) for _ in range(3)]
    assert len("".join(texts)) > 2 * bpe.LEARN_CHARS
    ids = [reference_encoder.encode_ordinary(t) for t in texts]
    for step, portions in ((bpe.ENCODE_BYTES, 1), (1 << 20, 3)):  # the smaller step has less memory
        sizes.clear()
        got = bpe.Bpe(bpe.load_ranks(data), pattern).encode_all(texts, step)
        assert [np.frombuffer(b, np.int32).tolist() for b in got] == ids
        known = [n for n in sizes if n > 100]  # the rest is what stands before the first spaces
        assert len(known) == portions and max(known) < max(bpe.LEARN_CHARS, step // 4) + 20


def test_bpe_step_changes_nothing(spark, tokenizer):
    data, pattern = tokenizer
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f"text {k} é" * (k % 5)) for k in range(40)], "doc_id long, text string").repartition(2)
    every = [sorted(map(tuple, bpe.encode(df, data, pattern, decoded="back", step_bytes=n).collect()), key=lambda r: r[0]) for n in (1, 64, 1 << 22)]
    assert every[0] == every[1] == every[2] and len(every[0]) == 40


def test_bpe_rows(spark, tokenizer, reference_encoder):
    data, pattern = tokenizer
    rows = [(1, None, "x", None, None), (2, "", "x", None, None), (3, "Hello there", "x", None, None), (3, "Hello there", "x", None, None)]
    df = bpe.encode(spark.createDataFrame(rows, DOCS), data, pattern)
    assert df.columns == ["doc_id", "text", "ids", "score", "labels", "_ids"]  # the name was taken
    got = sorted(tuple(r) for r in bpe.decode(df, data, ids="_ids").select("doc_id", "_ids", "decoded").collect())
    ids = reference_encoder.encode_ordinary("Hello there")
    assert [(a, b, bytes(c)) for a, b, c in got] == [(1, [], b""), (2, [], b""), (3, ids, b"Hello there"), (3, ids, b"Hello there")]
    assert bpe.encode(spark.createDataFrame([], DOCS), data, pattern).count() == 0


def test_op3_equals_reference(spark, reference_encoder):
    got = {r.doc_id: r for r in Q.op3_bpe_roundtrip(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = reference_encoder.encode_ordinary(d.text), got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def base_places(text):
    words = licences.words_of(text or "")
    out = []
    for phrase, label in licences.PHRASES.items():
        p = [w.encode() for w in phrase.split()]
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return words, out


def test_matching_statistics_equal_brute_force():
    a = licences.automaton_of(licences.TEMPLATES, licences.PHRASES)
    sequences = [licences.words_of(t) for _, t in licences.TEMPLATES] + [licences.words_of(p) for p in licences.PHRASES]
    factors = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    rng, vocab = random.Random(1), list(a.vocab)[:60]
    for _ in range(150):
        s, t = rng.choice(sequences), rng.choice(sequences)
        k = rng.randrange(len(s))
        words = [rng.choice(vocab) for _ in range(5)] + s[k:k + 9] + [b"zzz"] + t[:6]
        got = {i: n for i, _, n in a.statistics(words)}
        for i in range(len(words)):
            want = max((m for m in range(1, i + 2) if tuple(words[i - m + 1:i + 1]) in factors), default=0)
            assert got.get(i, 0) == want


def test_op7_equals_brute_force(spark):
    got = {r.doc_id: r for r in Q.op7_licences(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.n_base for r in got.values())
    for d in docs:
        words, places = base_places(d.text)
        r, starts = got[d.doc_id], [p for p, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_texts(spark):
    mit = licences.TEMPLATES[1][1]
    broken = " ".join(w for k, w in enumerate(mit.split()) if k % 23 != 7)
    rows = [(1, None), (2, ""), (3, "MIT License, MIT LICENSE; the mit-license"), (4, f"x {mit} y"), (5, broken), (6, "the software is"),
            (6, "the software is"), (7, "Licensed under CC BY-NC 4.0."), (8, "İMIT LICENSE mit licensee mıt license " * 3)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)
    out = licences.find_licences(df)
    assert out.columns[:5] == df.columns and "_labels" in out.columns and "_score" in out.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = (r.n_base, r.first_word, r.last_word, r.base_labels, r["_labels"], round(r["_score"], 2))
    assert got[1] == got[2] == (0, None, None, "", "", 0.0)
    assert got[3] == (3, 0, 5, "mit", "mit", 1.0)
    assert got[4][3:] == ("", "mit", 1.0)
    assert got[5][4] == "mit" and 0.75 <= got[5][5] < 1
    assert got[6] == (0, None, None, "", "", 0.0)
    assert got[7][4] == "cc-by-nc"
    assert got[8][0] == 0
    assert out.count() == len(rows) and licences.find_licences(df.limit(0)).count() == 0


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op5_compression_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert right / len(held) > 0.95
    kept = [d for d in held if not got[d.doc_id].rejected]
    assert len(kept) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_langid_cases(spark):
    text = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do ", "bb": "the quick brown fox jumps over the lazy dog again and "}
    teach = spark.createDataFrame([(t * k, lang) for lang, t in text.items() for k in range(1, 9)] + [(None, "aa"), ("123", "cc"), ("xyz", None)], "text string, lang string")
    model = langid.Model.fit(teach)
    assert list(model.dictionaries) == ["aa", "bb"]  # a text without letters teaches no language
    rows = [(1, None), (2, ""), (3, "12 34 --"), (4, "dolor sit amet lorem ipsum"), (5, "THE LAZY DOG JUMPS OVER!"), (5, "THE LAZY DOG JUMPS OVER!"), (6, "fox " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(df, model).orderBy("doc_id").collect()]
    assert got[:3] == [(k, "und", True) for k in (1, 2, 3)]
    assert [x[1] for x in got[3:]] == ["aa", "bb", "bb", "bb"]
    numerals = spark.createDataFrame([(1, "½ ² ③ Ⅷ 12", "x", "y", "z"), (2, "½ dolor sit amet", "x", "y", "z")], DOCS)
    assert [r.lang_pred for r in langid.predict(numerals, model).orderBy("doc_id").collect()] == ["und", "aa"]
    assert "_score" in langid.predict(df, model).columns
    none = langid.Model.fit(teach.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    # lang, source and id are no inputs: the same text gets the same answer
    again = df.withColumn("doc_id", F.col("doc_id") + 100)
    assert sorted(r.lang_pred for r in langid.predict(again, model).collect()) == sorted(x[1] for x in got)


def test_langid_learns_a_language_of_many_copies(spark):
    words = [f"{a}{b}{c}" for a in ("lor", "ips", "dol", "sit") for b in "aeiou" for c in ("met", "num", "lis")]
    rng = random.Random(4)
    different = [(" ".join(rng.choice(words) for _ in range(40)), "aa") for _ in range(40)]
    copies = spark.range(50_000).select(F.lit("always the same text of this language").alias("text"), F.lit("aa").alias("lang"))
    model = langid.Model.fit(spark.createDataFrame(different, "text string, lang string").union(copies))
    assert len(model.dictionaries["aa"].decode().split("\n")) == 41


def lm_loss(rows, k, row, vocabulary, pairs, scale):
    """Mean loss of text ``k`` under the model of the flagged (row 0) or of all other texts, counted one by one."""
    n, words, followed = vocabulary.size, collections.Counter(), collections.Counter()
    tokens = lambda t: vocabulary.ids(lm_score.tokens_of([t or ""], lm_score.Numbers())[0]).tolist()
    for j, (_, text, good) in enumerate(rows):
        if j != k and (row == 1 or good):
            ids = tokens(text)
            words.update(ids)
            if ids:
                words[lm_score._START] += 1
            followed.update(zip([lm_score._START, *ids], ids))
    factor = scale if row else 1.0
    total = max((sum(words.values()) - words[lm_score._START]) * factor, 1.0)
    loss, ids = [], tokens(rows[k][1])
    for v, w in zip([lm_score._START, *ids], ids):
        alone = (1 - lm_score.UNIFORM) * words[w] * factor / total + lm_score.UNIFORM / n
        pair = followed[v, w] * factor if (v, w) in pairs else 0.0
        in_pairs = sum(c for (a, b), c in followed.items() if a == v and (a, b) in pairs) * factor
        whole = words[v] * factor
        loss.append(-np.log((pair + (max(whole - in_pairs, 0) + lm_score.UNSEEN) * alone) / (max(whole, in_pairs) + lm_score.UNSEEN)))
    return sum(loss) / len(loss)


def test_lm_scores_equal_direct_computation(spark):
    rows = [(1, "a b a b c", True), (2, "c d c, d!", False), (3, "a b", None), (4, None, True), (5, "", False), (6, "b c d a a d c", True),
            (7, "Xyz d a b c", True), (8, "a b c. Qrs", False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, target boolean, score string")
    models = lm_score.Models.fit(df)
    n = models.vocabulary.size
    assert n == lm_score._FIRST_WORD + 4 and len(models.pairs)  # a, b, c, d: the others stand once
    pairs = {divmod(int(k), n) for k in models.pairs}
    scale = models.totals[0] / models.totals[1]
    got = {r.doc_id: r for r in lm_score.score(df, models).collect()}
    for k, (i, text, _) in enumerate(rows):
        r, size = got[i], len(lm_score._TOKENS(text or ""))
        assert r.n_tokens == size
        if not size:
            assert r["_score"] is None and r.target_loss is None
            continue
        loss = [lm_loss(rows, k, row, models.vocabulary, pairs, scale) for row in (0, 1)]
        assert np.allclose([r.target_loss, r.background_loss, r["_score"]], [*loss, loss[0] - loss[1]])
    nobody = df.withColumn("target", F.lit(False))
    assert all(r["_score"] is None for r in lm_score.score(nobody, lm_score.Models.fit(nobody)).collect())
    assert lm_score.score(df.limit(0), models).count() == 0 and lm_score.Models.fit(df.limit(0)).vocabulary.size == lm_score._FIRST_WORD
    assert lm_score.score(df.union(df), lm_score.Models.fit(df.union(df))).count() == 16


def test_lm_models_keep_every_word_and_pair_that_stands_twice(spark, monkeypatch):
    rng = random.Random(6)
    rare = [f"w{k}x" for k in range(80)]  # below a share of 2e-5
    rows = [(k, " ".join(["the", "of", "and"] * 2000 + rng.sample(rare, 6) + ["zz qq", f"Once{k}"]), k % 2 == 0) for k in range(40)]
    rows += [(k + 100, rows[3][1], False) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    words, followed = collections.Counter(), collections.Counter()
    for _, text, _ in rows:
        words.update(text.split())
    name = lambda w: w if words[w] > 1 else lm_score.shape_of(w)
    for _, text, _ in rows:
        ids = [name(w) for w in text.split()]
        followed.update(zip(["", *ids], ids))
    models = lm_score.Models.fit(df)
    assert models.vocabulary.size == lm_score._FIRST_WORD + sum(n > 1 for n in words.values())
    assert len(models.pairs) == sum(n > 1 for n in followed.values())
    n, scale = models.vocabulary.size, models.totals[0] / models.totals[1]
    pairs = {divmod(int(k), n) for k in models.pairs}
    got = {r.doc_id: r for r in lm_score.score(df, models).collect()}
    assert len(got) == len(rows) and len(models.frequent.ids) < n - 40
    for k in (0, 3, 7, 41):
        loss = [lm_loss(rows, k, row, models.vocabulary, pairs, scale) for row in (0, 1)]
        assert np.allclose([got[rows[k][0]].target_loss, got[rows[k][0]].background_loss], loss)
    monkeypatch.setattr(lm_score, "WORD_SHARE", 1.0)  # what is sent and what is joined changes nothing
    monkeypatch.setattr(lm_score, "PAIR_SHARE", 1.0)
    joined = {r.doc_id: r for r in lm_score.score(df, lm_score.Models.fit(df)).collect()}
    assert all(np.isclose(joined[i].score, got[i].score) for i in got)


def test_op2_tells_good_documents_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    good = labels.filter("quality = 1 AND toxic = 0").filter(half).select("doc_id", F.lit(True).alias("target"))
    flagged = docs.join(good, "doc_id", "left")
    models = lm_score.Models.fit(flagged)
    rows = (lm_score.score(flagged, models).join(labels, "doc_id").filter(~half).filter("toxic = 0")  # a toxic text differs in a word or two
            .select("score", F.expr("quality = 1").alias("good")).collect())
    a, b = ([r.score for r in rows if r.good == g] for g in (True, False))
    better = sum((x < y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))
    assert better > 0.9
    assert Q.op2_lm_score(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies, and you agree to that by reading on.</p></div>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy now, it is cheap and good.</div>
<article><h1>The  title</h1><p>First&nbsp;paragraph of &lt;text&gt;, with <b>bold</b> and <a href="/x">a link</a>.<br>Next line of it.<p>Second one, which
goes on &#233; for a while and ends here.</p>
<form><input name=q><button>Send</button></form><div class="comments"><p>First! I liked this text very much, thank you.</p></div></article>
<aside><p>Other readers also read this and that.</p></aside><footer>&copy; Someone, all rights reserved.</footer></body></html>"""


def test_html_cases(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    text = html_text.main_text(PAGE, model)
    assert text.startswith("The title First paragraph of <text>, with bold and a link. Next line of it. Second one, which goes on é for a while and ends here.")
    for gone in ("cookies", "Alpha", "hidden", "Buy", "Send", "liked", "Other readers", "rights", "margin", "T & U"):
        assert gone not in text
    rows = [(1, None), (2, ""), (3, "<p"), (4, "<nav>x</nav>"), (5, PAGE), (5, PAGE), (6, "<div>" * 3000 + "deep"), (7, "<article><p>" + "word " * 100_000)]
    df = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    out = html_text.extract(df, model)
    assert out.columns == ["page_id", "html", "text", "_text"] and out.count() == len(rows)
    got = {r.page_id: r["_text"] for r in out.collect()}
    assert got[1] == got[2] == got[4] == "" and got[5] == text and got[7] == " ".join(["word"] * 100_000)
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


HOSTILE = {"open tags": "<a ", "open quotes": '<a x="', "open sections": "<![CDATA[", "closed by a tag": "<![CDATA[>", "uneven quotes": "<a '\">",
           "uneven quotes with an end": "<a '\"x>\"", "declarations": "<!", "signs": "<", "ends": "</", "references": "&#9",
           "blocks": "<div>", "inline": "<b>", "ends of nothing": "<b></i>"}


@pytest.mark.parametrize("name", HOSTILE)
def test_parsing_takes_time_proportional_to_the_page(name):
    took = []
    for size in (1 << 17, 1 << 19):
        page = HOSTILE[name] * (size // len(HOSTILE[name])) + "<p>x</p>"
        begin = time.process_time()
        html_text.parse(page)
        took.append(time.process_time() - begin)
    assert took[1] < 12 * max(took[0], 0.05)  # four times the page; sixteen times the work if it were quadratic


def test_tags_of_broken_markup():
    leaves = lambda page: [n.text for n in html_text.parse(page) if n.tag == "#text"]
    assert leaves('<p title="a > b">x</p>') == ["x"]
    assert leaves('<p title="a > b>x</p>') == [" b>x"]  # quotes that are not even: the tag ends at the first >
    assert leaves("a < b<p>c") == ["a < b", "c"] and leaves("a<!-- <p>b") == ["a"] and leaves("a<p") == ["a<p"]
    assert leaves("<![CDATA[ <p> ]]>x<![CDATA[ <b>y") == ["xy"] and leaves("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert leaves("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"] and leaves("<p>a<div>b") == ["a", "b"]


def test_character_references_of_any_length():
    assert html_text.decoded("&amp;&#65;&#x42;&#00000000000067;&#x000000000044;") == "&ABCD"
    assert html_text.decoded("a&#" + "9" * 6000 + ";b&#x" + "f" * 6000) == "a\ufffdb\ufffd"


def test_html_fit_takes_a_page_once_however_often_it_stands(spark, monkeypatch):
    pages = [f"<html><body><nav>menu {k}</nav><article><p>{'word ' * (20 + k)}</p></article></body></html>" for k in range(30)]
    once = spark.createDataFrame([(p,) for p in pages], "html string")
    often = spark.createDataFrame([(p,) for p in pages + pages[:3] * 400], "html string").repartition(5)
    seen = []
    monkeypatch.setattr(html_text.Boosted, "fit", lambda x, y, trees: seen.append((x.copy(), y.copy())))
    for table, n in ((once, 600), (often, 600), (often, 10)):
        html_text.fit(table, fit_pages=n)
    assert (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()
    assert len(seen[2][1]) * 3 == len(seen[1][1])


def test_boosted_trees_of_a_small_table_are_walked_together():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 6))
    model = Boosted.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float), trees=60)
    mixed = Boosted(0.5, [*model.trees, *Boosted.fit(x, (x[:, 3] > 0).astype(float), trees=3, depth=1).trees])

    def one_by_one(m, rows):
        return m.base + sum((t.predict(rows) for t in m.trees), np.zeros(len(rows)))

    for m in (model, mixed, Boosted(0.25, [])):
        for n in (0, 1, 2, 40, 5000):
            assert (m.logit(x[:n]) == one_by_one(m, x[:n])).all()
    spent = []
    for f in (Boosted.logit, one_by_one):
        start = time.process_time()
        for k in range(200):
            f(model, x[k * 20:k * 20 + 40])
        spent.append(time.process_time() - start)
    assert spent[0] * 2 < spent[1]


def test_decoding_equals_brute_force_and_has_no_contradiction():
    rng = np.random.default_rng(3)
    for _ in range(40):
        nodes = [html_text.Node("#root", None, set())]
        for k in range(9):
            parent = nodes[rng.integers(0, len(nodes))]
            while parent.tag == "#text":
                parent = parent.parent
            nodes.append(html_text.Node("#text" if rng.random() < 0.4 else "div", parent, set()))
        order = []

        def walk(n):
            order.append(n)
            for c in n.children:
                walk(c)
        walk(nodes[0])
        for i, n in enumerate(order):
            n.index = i
        logit = rng.normal(size=len(order))
        best, chosen = -1.0, None
        for mask in range(1 << (len(order) - 1)):
            kept = [True, *[bool(mask >> k & 1) for k in range(len(order) - 1)]]
            if all(not kept[n.index] or kept[n.parent.index] for n in order[1:]):
                total = sum(logit[1:][kept[1:]])
                if total > best + 1e-12:
                    best, chosen = total, [n for n in order if kept[n.index] and n.tag == "#text"]
        assert html_text.kept_leaves(order, logit) == chosen


def test_op6_on_the_given_pages(spark):
    import html
    import re

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in Q.op6_html_main_text(spark, sf).collect()}
    right = 0
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", b).replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        r = got[p.page_id]
        right += r.text == " ".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == p.url
    assert right / len(pages) > 0.98


def test_lm_words_equal_the_pattern_and_shapes():
    rng = random.Random(8)
    texts = ["", " \n", "a", "!", "é́x ǅ \x1c\x85 b__1² Ab aB a1A AB1 ½ _", "𝒳y!?"]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(128)])) for _ in range(200)) for _ in range(50)]
    found = [lm_score._TOKENS(t) for t in texts]
    numbers, sizes = lm_score.tokens_of(texts, lm_score.Numbers())
    assert sizes.tolist() == [len(x) for x in found]
    known = {}
    for word, n in zip([w for x in found for w in x], numbers.tolist(), strict=True):
        assert known.setdefault(word, n) == n and n & 15 == lm_score.shape_of(word)
    assert len(set(known.values())) == len(known)


def test_lm_scores_do_not_depend_on_the_blocks_and_keep_less_than_the_texts(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 5) for k in range(3000)]
    rows = [(k, " ".join(rng.choices(words, weights, k=1500)), k % 3 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(2)
    kept = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(checkpoint_dir(spark).removeprefix("file:")) for x in names)
    before = kept()
    got = {r.doc_id: r for r in lm_score.score(df, lm_score.Models.fit(df)).collect()}
    assert 0 < kept() - before < sum(len(t) for _, t, _ in rows)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(lm_score, "STEP_TOKENS", 2_000)
    monkeypatch.setattr(lm_score, "STEP_BYTES", 10_000)
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", 2_000)
    other = {r.doc_id: r for r in lm_score.score(df, lm_score.Models.fit(df)).collect()}
    assert got.keys() == other.keys()
    assert all(np.isclose(got[i].target_loss, other[i].target_loss) and np.isclose(got[i].background_loss, other[i].background_loss) for i in got)
