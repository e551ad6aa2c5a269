"""Hand-written rows for the semantic traps (T1-T14) and the reference's invariants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from retentia.functions.columns import clip01, flag, zero_if_not_finite
from retentia.operators import features as feat
from retentia.operators import risk
from retentia.operators.snapshot import latest_snapshot, sanitize

D0 = dt.datetime(2024, 1, 1)


def _panel(spark, rows):
    cols = ["player_id", "date", "registration_date", "archetype", "sessions_per_week", "avg_session_length_mins",
            "days_since_last_login", "session_decay_rate", "win_rate", "kd_ratio", "current_rank", "rank_change",
            "friends_online", "party_play_percentage", "toxicity_reports_received", "monthly_spent",
            "days_since_last_purchase", "purchase_frequency", "achievements_unlocked", "content_completion_pct",
            "feature_adoption_pct"]
    schema = ("player_id long, date timestamp_ntz, registration_date timestamp_ntz, archetype string, "
              "sessions_per_week long, avg_session_length_mins double, days_since_last_login long, "
              "session_decay_rate double, win_rate double, kd_ratio double, current_rank long, rank_change long, "
              "friends_online long, party_play_percentage double, toxicity_reports_received long, "
              "monthly_spent double, days_since_last_purchase long, purchase_frequency long, "
              "achievements_unlocked long, content_completion_pct double, feature_adoption_pct double")
    return spark.createDataFrame([dict(zip(cols, r)) for r in rows], schema)


def _row(pid, days, **kw):
    base = dict(player_id=pid, date=D0 + dt.timedelta(days=days), registration_date=D0 - dt.timedelta(hours=36),
                archetype="casual", sessions_per_week=5, avg_session_length_mins=60.0, days_since_last_login=3,
                session_decay_rate=0.1, win_rate=0.5, kd_ratio=1.5, current_rank=50, rank_change=2, friends_online=3,
                party_play_percentage=0.5, toxicity_reports_received=0, monthly_spent=10.0,
                days_since_last_purchase=10, purchase_frequency=1, achievements_unlocked=10,
                content_completion_pct=0.5, feature_adoption_pct=0.5)
    base.update(kw)
    return tuple(base.values())


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        _row(1, 0, win_rate=0.4, monthly_spent=0.0, achievements_unlocked=5),
        _row(1, 7, win_rate=None, monthly_spent=20.0, achievements_unlocked=20, content_completion_pct=0.95),
        _row(1, 14, win_rate=0.6, monthly_spent=0.0, achievements_unlocked=20, content_completion_pct=0.95,
             sessions_per_week=0, days_since_last_login=20, session_decay_rate=0.6, friends_online=1,
             days_since_last_purchase=120),
        _row(2, 3, kd_ratio=9.0, session_decay_rate=1.7, archetype="hardcore"),
    ]
    return _panel(spark, rows)


def test_t1_latest_is_last_non_null_per_column(spark):
    df = spark.createDataFrame([(1, 1, 10.0, "a"), (1, 2, None, "b"), (1, 3, None, None), (2, 1, 5.0, None)],
                               "player_id long, date long, v double, s string")
    out = {r.player_id: r for r in latest_snapshot(df).collect()}
    assert out[1].v == 10.0 and out[1].s == "b" and out[1].date == 3
    assert out[2].v == 5.0 and out[2].s is None


def test_t2_null_comparison_is_false(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(flag(F.col("x") > 2)).collect()] == [0, 0, 1]


def test_t3_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (7.0,)], "x double")
    assert [r[0] for r in df.select(clip01("x")).collect()] == [None, 0.0, 0.5, 1.0]


def test_p6_sanitize_nan_inf(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None), (-float("inf"), 2.0)], "a double, b double")
    out = sanitize(df, ["a", "b"]).collect()
    assert [tuple(r) for r in out] == [(0.0, 1.0), (0.0, 0.0), (0.0, 2.0)]
    assert df.select(zero_if_not_finite("a")).collect()[0][0] == 0.0


def test_window_features_and_invariants(panel):
    out = {(r.player_id, r.date.day): r for r in feat.engineer_all(panel).collect()}
    p1 = [out[(1, d)] for d in (1, 8, 15)]
    # running spend never falls, rolling windows are row frames
    assert [r.total_spent for r in p1] == [0.0, 20.0, 20.0]
    assert p1[2].spending_rolling_3m == pytest.approx(20.0 / 3)
    # std of last 3 rows skips null; a single value gives 0
    assert p1[0].win_rate_std == 0.0 and p1[1].win_rate_std == 0.0
    assert p1[2].win_rate_std == pytest.approx(math.sqrt(0.02))
    # difference to the previous row, first row 0
    assert [r.achievement_velocity for r in p1] == [0.0, 15.0, 0.0]
    assert p1[2].content_exhausted == 1 and p1[1].content_exhausted == 0
    # 24-hour floor, Monday = 0 (2024-01-01 was a Monday)
    assert p1[0].account_age_days == 1 and p1[0].day_of_week == 0 and p1[0].is_weekend == 0
    # ranges and flags
    for r in out.values():
        for c in ("engagement_score", "activity_risk", "engagement_risk", "monetization_risk", "overall_risk_score"):
            assert 0.0 <= getattr(r, c) <= 1.0
        for c in ("skill_improving", "skill_declining", "low_social_engagement", "solo_player", "is_spender",
                  "is_whale", "recent_spender", "content_exhausted", "has_toxicity_issues", "is_weekend"):
            assert getattr(r, c) in (0, 1)
    # null win rate propagates to the performance score (pandas NaN arithmetic)
    assert p1[1].performance_score is None
    # kd 9 is clipped at 1 in the batch performance score
    p2 = out[(2, 4)]
    assert p2.performance_score == pytest.approx(0.5 * 0.5 + 1.0 * 0.3 + 0.5 * 0.2)
    assert p2.activity_consistency == 0.0  # decay 1.7 clipped to 1


def test_t6_serve_differs_from_batch(panel):
    s = {r.player_id: r for r in feat.serve_features(latest_snapshot(panel)).collect()}
    b = {r.player_id: r for r in latest_snapshot(feat.engineer_all(panel)).collect()}
    # this period's spend is 0: the request-time set says not a spender, the batch set has history
    assert s[1].is_spender == 0 and b[1].is_spender == 1
    assert s[2].avg_transaction_value == pytest.approx(10.0) and b[2].avg_transaction_value == pytest.approx(5.0)
    # no floor on the request-time activity consistency
    assert s[2].activity_consistency == 0.0


@pytest.mark.parametrize("score,left,right", [
    (0.0, "Low", None), (0.3, "Medium", "Low"), (0.7, "High", "Medium"), (1.0, "High", "High"),
    (0.2999999, "Low", "Low"), (None, None, None)])
def test_t7_band_edges(spark, score, left, right):
    df = spark.createDataFrame([(score,)], "s double")
    r = df.select(risk.risk_band(F.col("s")).alias("l"), risk.risk_band_cut(F.col("s")).alias("r")).collect()[0]
    assert (r.l, r.r) == (left, right)


def test_spending_segments(spark):
    df = spark.createDataFrame([(-0.5,), (-0.05,), (0.0,), (10.0,), (10.5,), (50.0,), (51.0,)], "x double")
    got = [r[0] for r in df.select(risk.spending_segment(F.col("x"))).collect()]
    assert got == [None, "Non-Spender", "Non-Spender", "Low Spender", "Medium Spender", "Medium Spender",
                   "High Spender"]


def test_k2_factors_ordered_and_capped(panel):
    lat = latest_snapshot(feat.engineer_all(panel))
    r = {x.player_id: x for x in risk.risk_factors(lat).collect()}
    names = [f.factor for f in r[1].top_risk_factors]
    assert names == ["Low Session Frequency", "Inactive Player", "Declining Engagement", "Low Social Connection",
                     "No Recent Purchases"]
    assert [f.impact for f in r[1].top_risk_factors] == sorted([f.impact for f in r[1].top_risk_factors], reverse=True)
    assert [f.factor for f in r[2].top_risk_factors] == ["Declining Engagement"]  # decay 1.7 > 0.3


def test_k9_rule_probability(panel):
    r = {x.player_id: x.churn_probability for x in risk.rule_churn_probability(latest_snapshot(panel)).collect()}
    assert r[1] == 1.0  # 0.3+0.3+0.2+0.1+0.1 clipped
    assert r[2] == 0.0  # hardcore -0.3 clipped at 0


def test_t10_bucketed_auc_equals_exact(spark):
    from retentia.operators.evaluate import evaluate
    rows = [(i, s, y) for i, (s, y) in enumerate(
        [(0.91, 1), (0.85, 1), (0.85, 0), (0.6, 0), (0.55, 1), (0.4, 0), (0.31, 1), (0.2, 0), (0.1, 0), (0.1, 1)])]
    df = spark.createDataFrame(rows, "player_id long, churn_risk_score double, churned int")
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    exact = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    r = evaluate(df).collect()[0]
    assert r.roc_auc == pytest.approx(exact, abs=1e-12)
    assert (r.tp, r.fp, r.tn, r.fn) == (3, 2, 3, 2)


def test_t11_division_by_zero_is_null(spark):
    from retentia.functions.columns import safe_div
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 0.5]


def test_t12_relative_lift_zero_without_retention(spark):
    from retentia.operators import experiment as ab
    row = spark.createDataFrame([(10, 10, 10, 5)],
                                "control_n long, control_churned long, treatment_n long, treatment_churned long")
    r = row.select(*[c.alias(n) for n, c in ab.retention_columns().items()]).collect()[0]
    assert r.control_retention == 0.0 and r.relative_lift == 0.0 and r.absolute_lift == 0.5


def test_t13_ties_break_by_player_id(spark):
    from retentia.operators.segments import top_n_risk
    df = spark.createDataFrame([(5, 0.9), (3, 0.9), (4, 0.9), (1, 0.2)], "player_id long, churn_risk_score double")
    assert [r.player_id for r in top_n_risk(df, 2).collect()] == [3, 4]


@pytest.mark.parametrize("props,want", [
    ('{"k": 69}', 69), ('{"k":7,"x":1}', 7), ('{"x": 1, "k": 5}', 5), ('{"a": {"k": 1}, "k": 2}', 2),
    ('{"a": {"k": 1}}', None), ('{"k": -3}', -3), ('{"k": "12"}', 12), ('{}', None), (None, None)])
def test_props_k_matches_the_json_path(spark, props, want):
    from retentia.sources.panel import props_k
    df = spark.createDataFrame([(props,)], "props string")
    assert df.select(props_k()).collect()[0][0] == want


def test_model_input_is_clean_and_excludes_ids(spark):
    """L1 on the real tables: one row per player, no null / NaN / inf features, id and label columns excluded."""
    from conftest import MEDIUM
    from retentia.operators.snapshot import NON_FEATURE_COLUMNS, prepare_model_data
    from retentia.plans import frames
    data, cols = prepare_model_data(frames.features(spark, MEDIUM))
    assert not set(cols) & set(NON_FEATURE_COLUMNS)
    assert data.count() == data.select("player_id").distinct().count()
    bad = data.select(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                                   | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in cols]).first()
    assert all(v == 0 for v in bad), {c: v for c, v in bad.asDict().items() if v}
