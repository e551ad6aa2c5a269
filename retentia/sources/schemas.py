"""Declared table schemas (S13) and the panel input contract.

REAL columns are widened to DOUBLE: every computation upstream is float64.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _TS, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


def _nullable(names_types: list[tuple[str, T.DataType]]) -> list[tuple[str, T.DataType, bool]]:
    return [(n, t, True) for n, t in names_types]


# player_features: the engineered panel, one row per (player_id, date).
PLAYER_FEATURES = _struct(
    ("player_id", _S, False),
    ("date", _TS, False),
    *_nullable([
        ("archetype", _S), ("sessions_per_week", _I), ("avg_session_length_mins", _D),
        ("days_since_last_login", _I), ("session_decay_rate", _D), ("activity_consistency", _D),
        ("engagement_score", _D), ("total_playtime_hours", _D), ("sessions_trend", _D),
        ("win_rate", _D), ("kd_ratio", _D), ("current_rank", _I), ("rank_change", _I),
        ("performance_score", _D), ("skill_improving", _I), ("skill_declining", _I),
        ("win_rate_std", _D), ("friends_online", _I), ("party_play_percentage", _D),
        ("toxicity_reports_received", _I), ("social_engagement", _D), ("low_social_engagement", _I),
        ("solo_player", _I), ("has_toxicity_issues", _I), ("monthly_spent", _D),
        ("days_since_last_purchase", _I), ("purchase_frequency", _I), ("total_spent", _D),
        ("is_spender", _I), ("is_whale", _I), ("recent_spender", _I), ("spending_velocity", _D),
        ("avg_transaction_value", _D), ("spending_trend", _D), ("achievements_unlocked", _I),
        ("content_completion_pct", _D), ("feature_adoption_pct", _D), ("content_engagement", _D),
        ("achievement_velocity", _D), ("content_exhausted", _I), ("activity_risk", _D),
        ("engagement_risk", _D), ("monetization_risk", _D), ("overall_risk_score", _D),
        ("registration_date", _TS), ("country", _S), ("platform", _S), ("account_age_days", _I),
        ("day_of_week", _I), ("month", _I), ("is_weekend", _I), ("churned", _I),
        ("churn_probability", _D),
    ]),
)

RISK_FACTOR = T.StructType([
    T.StructField("factor", _S, False),
    T.StructField("impact", _D, False),
    T.StructField("value", _D, True),
])

DAILY_PREDICTIONS = _struct(
    ("prediction_id", _S, False),
    ("player_id", _S, False),
    *_nullable([
        ("prediction_date", _TS), ("churn_probability", _D), ("risk_category", _S),
        ("model_version", _S), ("top_risk_factors", T.ArrayType(RISK_FACTOR)),
    ]),
)

INTERVENTIONS = _struct(
    ("intervention_id", _S, False),
    ("player_id", _S, False),
    *_nullable([
        ("intervention_date", _TS), ("intervention_type", _S), ("intervention_cost", _D),
        ("status", _S), ("result", _S), ("notes", _S),
    ]),
)

AB_TESTS = _struct(
    ("test_id", _S, False),
    ("test_name", _S, False),
    *_nullable([
        ("start_date", _TS), ("end_date", _TS), ("intervention_type", _S), ("control_size", _D),
        ("treatment_size", _D), ("control_churn_rate", _D), ("treatment_churn_rate", _D),
        ("lift_percentage", _D), ("p_value", _D), ("is_significant", _B), ("status", _S),
        ("results", _S),
    ]),
)

MODEL_MONITORING = _struct(
    ("monitor_id", _S, False),
    *_nullable([
        ("monitor_date", _TS), ("metric_name", _S), ("metric_value", _D), ("threshold_value", _D),
        ("alert_triggered", _B), ("notes", _S),
    ]),
)

# The raw panel: the 17 measures plus identity, profile and label columns.
PANEL = T.StructType([
    T.StructField("player_id", T.LongType(), False),
    T.StructField("date", _TS, False),
    T.StructField("registration_date", _TS, True),
    T.StructField("archetype", _S, True),
    T.StructField("platform", _S, True),
    T.StructField("country", _S, True),
    T.StructField("sessions_per_week", T.LongType(), True),
    T.StructField("avg_session_length_mins", _D, True),
    T.StructField("days_since_last_login", T.LongType(), True),
    T.StructField("session_decay_rate", _D, True),
    T.StructField("win_rate", _D, True),
    T.StructField("kd_ratio", _D, True),
    T.StructField("current_rank", T.LongType(), True),
    T.StructField("rank_change", T.LongType(), True),
    T.StructField("friends_online", T.LongType(), True),
    T.StructField("party_play_percentage", _D, True),
    T.StructField("toxicity_reports_received", T.LongType(), True),
    T.StructField("monthly_spent", _D, True),
    T.StructField("days_since_last_purchase", T.LongType(), True),
    T.StructField("purchase_frequency", T.LongType(), True),
    T.StructField("achievements_unlocked", T.LongType(), True),
    T.StructField("content_completion_pct", _D, True),
    T.StructField("feature_adoption_pct", _D, True),
    T.StructField("churned", T.IntegerType(), True),
])

# Fields of the landed profile payloads.
PROFILE_PAYLOAD = T.StructType([
    T.StructField("steamid", _S),
    T.StructField("summary", T.StructType([
        T.StructField("timecreated", T.LongType()), T.StructField("lastlogoff", T.LongType()),
        T.StructField("communityvisibilitystate", T.LongType())])),
    T.StructField("friends", T.ArrayType(T.StructType([T.StructField("steamid", _S)]))),
    T.StructField("games", T.ArrayType(T.StructType([
        T.StructField("appid", T.LongType()), T.StructField("playtime_forever", T.LongType()),
        T.StructField("playtime_2weeks", T.LongType())]))),
    T.StructField("playerstats", T.StructType([
        T.StructField("achievements", T.ArrayType(T.StructType([
            T.StructField("apiname", _S), T.StructField("achieved", T.LongType())]))),
        T.StructField("stats", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("value", _D)])))])),
])
