"""Property tests: window and snapshot operators against pandas semantics on random frames."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia.operators.features import rolling_mean_3, rolling_std_3, row_diff, running_sum
from retentia.operators.snapshot import latest_snapshot

VALUE = st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False).map(lambda x: round(x, 3)))
ROWS = st.lists(st.tuples(st.integers(1, 4), st.integers(0, 30), VALUE, VALUE), min_size=1, max_size=25)
CFG = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(rows):
    seen, out = set(), []
    for pid, day, a, b in rows:  # the panel key (player_id, date) is unique
        if (pid, day) not in seen:
            seen.add((pid, day))
            out.append((pid, day, a, b))
    return out


def _close(x, y):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return y is None or (isinstance(y, float) and math.isnan(y))
    return y is not None and not (isinstance(y, float) and math.isnan(y)) and abs(x - y) <= 1e-9 * max(1, abs(x))


@CFG
@given(rows=ROWS)
def test_latest_snapshot_is_groupby_last(spark, rows):
    data = _frame(rows)
    sdf = spark.createDataFrame(data, "player_id long, date long, a double, b double")
    got = {r.player_id: (r.date, r.a, r.b) for r in latest_snapshot(sdf).collect()}
    pdf = pd.DataFrame(data, columns=["player_id", "date", "a", "b"]).astype({"a": float, "b": float}) \
        .sort_values("date")
    want = pdf.groupby("player_id").last()
    assert set(got) == set(want.index)
    for pid, row in want.iterrows():
        d, a, b = got[pid]
        assert d == row["date"] and _close(row["a"], a) and _close(row["b"], b)


@CFG
@given(rows=ROWS)
def test_windows_match_plain_lists(spark, rows):
    import statistics

    data = _frame(rows)
    sdf = spark.createDataFrame(data, "player_id long, date long, a double, b double")
    out = sdf.select("player_id", "date", rolling_mean_3("a").alias("m"), rolling_std_3("a").alias("s"),
                     running_sum("a").alias("c"), row_diff("a").alias("d")).collect()
    got = {(r.player_id, r.date): r for r in out}
    players: dict = {}
    for pid, date, a, _ in sorted(data, key=lambda r: r[:2]):
        players.setdefault(pid, []).append((date, a))
    for pid, series in players.items():
        for k, (date, a) in enumerate(series):
            r = got[(pid, date)]
            last3 = [x for _, x in series[max(0, k - 2):k + 1] if x is not None]
            upto = [x for _, x in series[:k + 1] if x is not None]
            before = series[k - 1][1] if k else None
            nan = float("nan")
            assert _close(statistics.fmean(last3) if last3 else nan, r.m)
            assert _close(nan if a is None else sum(upto), r.c)
            assert _close(0.0 if a is None or before is None else a - before, r.d)
            spread = statistics.stdev(last3) if len(last3) > 1 else 0.0
            assert abs(spread - r.s) <= 1e-6 * max(1, abs(spread))


SCORES = st.lists(st.one_of(st.none(), st.floats(min_value=-0.5, max_value=1.5, allow_nan=False)), min_size=1,
                  max_size=30)


@CFG
@given(xs=SCORES)
def test_right_closed_bins_match_pd_cut(spark, xs):
    from retentia.operators.risk import risk_band_cut, spending_segment
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(risk_band_cut(F.col("x")).alias("b"), spending_segment(F.col("x") * 100).alias("s")).collect()
    s = pd.Series(xs, dtype=float)
    bands = pd.cut(s, bins=[0, 0.3, 0.7, 1.0], labels=["Low", "Medium", "High"])
    segs = pd.cut(s * 100, bins=[-0.1, 0, 10, 50, float("inf")],
                  labels=["Non-Spender", "Low Spender", "Medium Spender", "High Spender"])
    for r, b, g in zip(got, bands, segs):
        assert r.b == (None if pd.isna(b) else b)
        assert r.s == (None if pd.isna(g) else g)


@CFG
@given(xs=SCORES)
def test_histogram_covers_every_value(spark, xs):
    from retentia.operators.segments import score_histogram
    df = spark.createDataFrame([(x,) for x in xs], "churn_risk_score double")
    bins = score_histogram(df, bins=7).collect()
    vals = [x for x in xs if x is not None]
    assert sum(b.players for b in bins) == len(vals)
    assert all(1 <= b.bin <= 7 for b in bins)
    if vals and max(vals) > min(vals):
        for x in vals:  # every value lies in the closed range of some bin
            assert any(b.bin_lo - 1e-9 <= x <= b.bin_hi + 1e-9 for b in bins)


PAIRS = st.lists(st.tuples(VALUE, VALUE, VALUE), min_size=3, max_size=25)


@CFG
@given(rows=PAIRS)
def test_correlations_match_pandas_pairwise(spark, rows):
    from retentia.operators.segments import correlation_with
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = {r.feature: r.correlation for r in correlation_with(df, "y", ["a", "b"]).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "y"]).astype(float)
    want = pdf.corr()["y"]
    assert set(got) == {"a", "b"}  # every requested column gets a row
    for c in ("a", "b"):
        w, g = want[c], got[c]
        if pd.isna(w):  # no complete pair, or a constant column
            assert g is None or abs(g) <= 1 + 1e-9
        else:
            assert g is not None and abs(w - g) <= 1e-6


DRIFT_ROWS = st.lists(st.tuples(st.integers(0, 20), VALUE), min_size=1, max_size=30)


@CFG
@given(rows=DRIFT_ROWS)
def test_feature_drift_matches_pandas(spark, rows):
    import datetime as dt
    from retentia.operators.monitor import feature_drift
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(days=d), x) for i, (d, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "player_id long, date timestamp_ntz, x double")
    r = feature_drift(df, ["x"], days=7).collect()[0]
    pdf = pd.DataFrame(data, columns=["player_id", "date", "x"]).astype({"x": float})
    cur = pdf["date"] > pdf["date"].max() - pd.Timedelta(days=7)
    mc, mh, sh = pdf.loc[cur, "x"].mean(), pdf.loc[~cur, "x"].mean(), pdf.loc[~cur, "x"].std()
    assert _close(mc, r.mean_current) and _close(mh, r.mean_history)
    if pd.isna(sh):
        assert r.std_history is None or r.std_history == 0.0
    else:
        assert r.std_history is not None and abs(sh - r.std_history) <= 1e-6 * max(1.0, abs(sh))


EVAL_ROWS = st.lists(st.tuples(st.floats(min_value=0, max_value=1, allow_nan=False).map(lambda x: round(x, 4)),
                               st.integers(0, 1)), min_size=2, max_size=40)


@CFG
@given(rows=EVAL_ROWS)
def test_evaluation_matches_direct_computation(spark, rows):
    from retentia.operators.evaluate import evaluate
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(rows)],
                               "player_id long, churn_risk_score double, churned int")
    r = evaluate(df).collect()[0]
    tp = sum(1 for s, y in rows if s > 0.5 and y == 1)
    fp = sum(1 for s, y in rows if s > 0.5 and y == 0)
    tn = sum(1 for s, y in rows if s <= 0.5 and y == 0)
    fn = sum(1 for s, y in rows if s <= 0.5 and y == 1)
    assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn)
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    assert r.precision == pytest.approx(prec) and r.recall == pytest.approx(rec)
    assert r.f1 == pytest.approx(2 * prec * rec / (prec + rec) if prec + rec else 0.0)
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if pos and neg:
        auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert r.roc_auc == pytest.approx(auc, abs=1e-12)
    else:
        assert r.roc_auc is None


KV = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 3), VALUE), max_size=15)


@CFG
@given(target=KV, updates=KV)
def test_upsert_is_dict_update(spark, target, updates):
    from retentia.sources.sinks import upsert
    t = {(a, b): v for a, b, v in target}
    u = {(a, b): v for a, b, v in updates}
    schema = "a long, b long, v double"
    out = upsert(spark.createDataFrame([(a, b, v) for (a, b), v in t.items()], schema),
                 spark.createDataFrame([(a, b, v) for (a, b), v in u.items()], schema), ["a", "b"]).collect()
    want = {**t, **u}
    assert len(out) == len(want)
    assert {(r.a, r.b): r.v for r in out} == want


QROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), VALUE), min_size=1, max_size=25)


@CFG
@given(rows=QROWS)
def test_data_quality_matches_pandas(spark, rows):
    from retentia.operators.monitor import data_quality
    df = spark.createDataFrame(rows, "player_id long, date long, x double")
    got = {r.check: r.failures for r in data_quality(df, ["player_id", "date"], {"x": (-10.0, 10.0)}).collect()}
    pdf = pd.DataFrame(rows, columns=["player_id", "date", "x"]).astype({"x": float})
    assert got["duplicate_keys"] == int(pdf.duplicated(["player_id", "date"]).sum())
    assert got["nulls:x"] == int(pdf["x"].isna().sum())
    assert got["out_of_range:x"] == int(((pdf["x"] < -10) | (pdf["x"] > 10)).sum())


SEG_ROWS = st.lists(st.tuples(st.sampled_from(["Low", "Medium", "High"]),
                              st.floats(min_value=0, max_value=80, allow_nan=False).map(lambda x: round(x, 1))),
                    min_size=1, max_size=30)


@CFG
@given(rows=SEG_ROWS)
def test_segment_matrix_matches_crosstab(spark, rows):
    from retentia.operators.segments import SPEND_SEGMENTS, _snake, segment_matrix
    df = spark.createDataFrame(rows, "risk_category string, monthly_spent double")
    got = {r.risk_category: r for r in segment_matrix(df).collect()}
    pdf = pd.DataFrame(rows, columns=["risk_category", "monthly_spent"])
    pdf["seg"] = pd.cut(pdf["monthly_spent"], bins=[-0.1, 0, 10, 50, float("inf")], labels=list(SPEND_SEGMENTS))
    ct = pd.crosstab(pdf["risk_category"], pdf["seg"])
    for band in ct.index:
        for seg in SPEND_SEGMENTS:
            want = int(ct.loc[band, seg]) if seg in ct.columns else 0
            assert getattr(got[band], _snake(seg)) == want


FACTOR_ROWS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30), st.floats(0, 1).map(lambda x: round(x, 2)),
                                 st.integers(0, 5), st.integers(0, 200)), min_size=1, max_size=20)


@CFG
@given(rows=FACTOR_ROWS)
def test_risk_factors_follow_the_rules(spark, rows):
    from retentia.operators.risk import RISK_FACTOR_RULES, risk_factors
    cols = "sessions_per_week long, days_since_last_login long, session_decay_rate double, friends_online long, " \
           "days_since_last_purchase long"
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "player_id long, " + cols)
    got = {r.player_id: [f.factor for f in r.top_risk_factors] for r in risk_factors(df).collect()}
    names = ["sessions_per_week", "days_since_last_login", "session_decay_rate", "friends_online",
             "days_since_last_purchase"]
    for row in data:
        vals = dict(zip(names, row[1:]))
        fired = [(impact, name) for name, impact, c, _ in RISK_FACTOR_RULES
                 if {"sessions_per_week": vals[c] < 2, "days_since_last_login": vals[c] > 14,
                     "session_decay_rate": vals[c] > 0.3, "friends_online": vals[c] < 2,
                     "days_since_last_purchase": vals[c] > 90}[c]]
        want = [n for _, n in sorted(fired, key=lambda t: -t[0])][:5]
        assert got[row[0]] == want


STR_ROWS = st.lists(st.tuples(st.integers(1, 4), st.integers(0, 30), st.one_of(st.none(), st.sampled_from("xyz")), VALUE),
                    min_size=1, max_size=25)


@CFG
@given(rows=STR_ROWS)
def test_first_last_skip_missing_like_pandas(spark, rows):
    from retentia.operators.snapshot import first_last
    data = _frame(rows)
    sdf = spark.createDataFrame(data, "player_id long, date long, s string, v double")
    got = {r.player_id: r for r in first_last(sdf, first=["s", "v"], last=["s", "v"]).collect()}
    pdf = pd.DataFrame(data, columns=["player_id", "date", "s", "v"]).astype({"v": float}).sort_values("date")
    g = pdf.groupby("player_id")
    first, last = g.first(), g.last()
    def same(want, have):
        if isinstance(want, str) or isinstance(have, str):
            return have == (None if pd.isna(want) else want)
        return _close(want, have)

    for pid in first.index:
        r = got[pid]
        assert same(first.loc[pid, "s"], r.first_s) and same(first.loc[pid, "v"], r.first_v)
        assert same(last.loc[pid, "s"], r.last_s) and same(last.loc[pid, "v"], r.last_v)
