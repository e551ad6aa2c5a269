"""Feature operators (F1-F32) and per-player sequence windows.

Batch features are computed on the panel with one window specification,
``partitionBy(player_id).orderBy(date)``; every windowed column shares it, so
the whole eight-stage chain costs one exchange and one sort.  Row frames only:
"3m" means the last three rows, as in the source computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import cap1, clip01, flag, safe_div

KEY, ORDER = "player_id", "date"


def player_window(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order)


def _last3(key: str = KEY, order: str = ORDER):
    return player_window(key, order).rowsBetween(-2, Window.currentRow)


def _c(name: str) -> Column:
    return F.col(name)


# ---------------------------------------------------------------- W1-W6
def rolling_mean_3(c: str, key: str = KEY, order: str = ORDER) -> Column:
    """Mean of the last three rows (min one non-null)."""
    return F.avg(c).over(_last3(key, order))


def rolling_std_3(c: str, key: str = KEY, order: str = ORDER) -> Column:
    """Sample std of the last three rows; one value (or none) gives 0."""
    return F.coalesce(F.stddev_samp(c).over(_last3(key, order)), F.lit(0.0))


def running_sum(c: str, key: str = KEY, order: str = ORDER) -> Column:
    """Cumulative sum per player; null where the input is null (pandas ``cumsum``)."""
    w = player_window(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(F.sum(c).over(w))


def row_diff(c: str, key: str = KEY, order: str = ORDER) -> Column:
    """Difference to the previous row; the first row (or a null) gives 0."""
    return F.coalesce((_c(c) - F.lag(c).over(player_window(key, order))).cast("double"), F.lit(0.0))


def decay_rate(c: str, key: str = KEY, order: str = ORDER) -> Column:
    """(previous - current) / max(1, previous); the first row gives 0."""
    prev = F.lag(c).over(player_window(key, order))
    return F.coalesce(safe_div(prev - _c(c), F.greatest(prev, F.lit(1))), F.lit(0.0))


# ---------------------------------------------------------------- stages
def time_features(df: DataFrame) -> DataFrame:
    """F1-F4.  Account age is a floor of whole 24-hour periods (not calendar days)."""
    dow = F.weekday("date")
    cols = {}
    if "registration_date" in df.columns:
        micros = F.timestamp_diff("MICROSECOND", _c("registration_date"), _c("date"))
        cols["account_age_days"] = F.floor(micros / F.lit(86_400_000_000.0)).cast("long")
    cols.update({"day_of_week": dow, "month": F.month("date"), "is_weekend": flag(dow.isin(5, 6))})
    return df.withColumns(cols)


def behaviour_features(df: DataFrame) -> DataFrame:
    """F5-F8 with W1."""
    s, length, idle = _c("sessions_per_week"), _c("avg_session_length_mins"), _c("days_since_last_login")
    # Window values first, read by name afterwards: Spark evaluates every occurrence of a window
    # expression separately, so a reused window Column would be computed twice.
    df = df.withColumns({
        "total_playtime_hours": s * length * F.lit(4) / F.lit(60),
        "activity_consistency": F.lit(1) - clip01("session_decay_rate"),
        "engagement_score": clip01(
            s / F.lit(20) * F.lit(0.3) + length / F.lit(120) * F.lit(0.3) + (F.lit(1) - idle / F.lit(30)) * F.lit(0.4)
        ),
        "sessions_per_week_rolling_3m": rolling_mean_3("sessions_per_week"),
        "avg_session_length_mins_rolling_3m": rolling_mean_3("avg_session_length_mins"),
    })
    return df.withColumn("sessions_trend", s / (_c("sessions_per_week_rolling_3m") + F.lit(0.1)))


def performance_features(df: DataFrame) -> DataFrame:
    """F9-F11 with W3."""
    return df.withColumns({
        "performance_score": _c("win_rate") * F.lit(0.5) + clip01(_c("kd_ratio") / F.lit(3)) * F.lit(0.3)
        + _c("current_rank") / F.lit(100) * F.lit(0.2),
        "skill_improving": flag(_c("rank_change") > 0),
        "skill_declining": flag(_c("rank_change") < -5),
        "win_rate_std": rolling_std_3("win_rate"),
    })


def social_features(df: DataFrame) -> DataFrame:
    """F12-F15."""
    return df.withColumns({
        "social_engagement": clip01(_c("friends_online") / F.lit(15)) * F.lit(0.6)
        + _c("party_play_percentage") * F.lit(0.4),
        "low_social_engagement": flag(_c("friends_online") < 2),
        "solo_player": flag(_c("party_play_percentage") < 0.2),
        "has_toxicity_issues": flag(_c("toxicity_reports_received") > 0),
    })


def money_features(df: DataFrame) -> DataFrame:
    """F16-F21 with W2 and W4."""
    spend, freq = _c("monthly_spent"), _c("purchase_frequency")
    df = df.withColumns({
        "total_spent": running_sum("monthly_spent"),
        "spending_rolling_3m": rolling_mean_3("monthly_spent"),
    })
    total = _c("total_spent")
    return df.withColumns({
        "is_spender": flag(total > 0),
        "is_whale": flag(total > 500),
        "recent_spender": flag(_c("days_since_last_purchase") < 30),
        "spending_velocity": spend * freq,
        "avg_transaction_value": spend / (freq + F.lit(1)),
        "spending_trend": spend / (_c("spending_rolling_3m") + F.lit(0.1)),
    })


def content_features(df: DataFrame) -> DataFrame:
    """F22-F23 with W5."""
    df = df.withColumns({
        "content_engagement": _c("content_completion_pct") * F.lit(0.4) + _c("feature_adoption_pct") * F.lit(0.3)
        + clip01(_c("achievements_unlocked") / F.lit(100)) * F.lit(0.3),
        "achievement_velocity": row_diff("achievements_unlocked"),
    })
    return df.withColumn(
        "content_exhausted", flag((_c("content_completion_pct") > 0.9) & (_c("achievement_velocity") < 1)))


def risk_features(df: DataFrame) -> DataFrame:
    """F24-F27 (batch weights)."""
    activity = (flag(_c("sessions_per_week") < 2) * 3 + flag(_c("days_since_last_login") > 14) * 3
                + flag(_c("session_decay_rate") > 0.3) * 2) / F.lit(8)
    engagement = (flag(_c("engagement_score") < 0.3) * 2 + _c("low_social_engagement") * 2
                  + _c("content_exhausted")) / F.lit(5)
    money = (flag(_c("days_since_last_purchase") > 90) * 2 + flag(_c("spending_trend") < 0.5)
             + (F.lit(1) - _c("is_spender"))) / F.lit(4)
    return df.withColumns({
        "activity_risk": activity, "engagement_risk": engagement, "monetization_risk": money,
        "overall_risk_score": overall_risk(activity, engagement, money),
    })


def overall_risk(activity: Column | None = None, engagement: Column | None = None,
                 money: Column | None = None) -> Column:
    activity = _c("activity_risk") if activity is None else activity
    engagement = _c("engagement_risk") if engagement is None else engagement
    money = _c("monetization_risk") if money is None else money
    return activity * F.lit(0.4) + engagement * F.lit(0.3) + money * F.lit(0.3)


def interaction_features(df: DataFrame) -> DataFrame:
    """F28-F30."""
    return df.withColumns({
        "performance_engagement": _c("performance_score") * _c("engagement_score"),
        "social_spending": _c("social_engagement") * _c("spending_velocity"),
        "activity_monetization": _c("sessions_per_week") * _c("monthly_spent"),
    })


STAGES = (
    time_features, behaviour_features, performance_features, social_features,
    money_features, content_features, risk_features, interaction_features,
)


def engineer_all(df: DataFrame) -> DataFrame:
    """F32: the eight stages in order."""
    for stage in STAGES:
        df = df.transform(stage)
    return df


# ---------------------------------------------------------------- F31 (request-time set)
# Defaults applied to absent request fields.
SERVE_DEFAULTS = {
    "session_decay_rate": 0.0, "win_rate": 0.5, "kd_ratio": 1.0, "current_rank": 50, "rank_change": 0,
    "friends_online": 0, "party_play_percentage": 0.0, "toxicity_reports_received": 0, "monthly_spent": 0.0,
    "days_since_last_purchase": 180, "purchase_frequency": 0, "achievements_unlocked": 0,
    "content_completion_pct": 0.0, "feature_adoption_pct": 0.0,
}
SERVE_REQUIRED = ("sessions_per_week", "avg_session_length_mins", "days_since_last_login")


def serve_features(df: DataFrame) -> DataFrame:
    """features of single rows without history, with request defaults.

    Differs from the batch set on purpose: no floors on min() caps, spender
    means this period's spend, a transaction divides by max(1, purchases),
    and the engagement / money risks drop the exhausted / trend terms.
    """
    missing = [c for c in SERVE_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"serve_features: required columns missing: {missing}")
    df = df.withColumns({
        c: (F.coalesce(_c(c), F.lit(v)) if c in df.columns else F.lit(v)) for c, v in SERVE_DEFAULTS.items()
    })
    s, length, idle = _c("sessions_per_week"), _c("avg_session_length_mins"), _c("days_since_last_login")
    spend, freq = _c("monthly_spent"), _c("purchase_frequency")
    df = df.withColumns({
        "total_playtime_hours": s * length * F.lit(4) / F.lit(60),
        "activity_consistency": F.lit(1) - cap1("session_decay_rate"),
        # null where a required field is: greatest() and least() would skip it
        "engagement_score": F.when(s.isNotNull() & length.isNotNull() & idle.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0),
            s / F.lit(20) * F.lit(0.3) + length / F.lit(120) * F.lit(0.3) + (F.lit(1) - idle / F.lit(30)) * F.lit(0.4)))),
        "performance_score": _c("win_rate") * F.lit(0.5) + cap1(_c("kd_ratio") / F.lit(3)) * F.lit(0.3)
        + _c("current_rank") / F.lit(100) * F.lit(0.2),
        "skill_improving": flag(_c("rank_change") > 0),
        "skill_declining": flag(_c("rank_change") < -5),
        "social_engagement": cap1(_c("friends_online") / F.lit(15)) * F.lit(0.6)
        + _c("party_play_percentage") * F.lit(0.4),
        "low_social_engagement": flag(_c("friends_online") < 2),
        "solo_player": flag(_c("party_play_percentage") < 0.2),
        "has_toxicity_issues": flag(_c("toxicity_reports_received") > 0),
        "is_spender": flag(spend > 0),
        "recent_spender": flag(_c("days_since_last_purchase") < 30),
        "spending_velocity": spend * freq,
        "avg_transaction_value": spend / F.greatest(freq, F.lit(1)),
        "content_engagement": _c("content_completion_pct") * F.lit(0.4) + _c("feature_adoption_pct") * F.lit(0.3)
        + cap1(_c("achievements_unlocked") / F.lit(100)) * F.lit(0.3),
        "activity_risk": (flag(s < 2) * 3 + flag(idle > 14) * 3 + flag(_c("session_decay_rate") > 0.3) * 2) / F.lit(8),
    })
    df = df.withColumns({
        "engagement_risk": F.when(_c("engagement_score").isNotNull(),
                                  ((_c("engagement_score") < 0.3).cast("int") * 2 + _c("low_social_engagement") * 2) / F.lit(4)),
        "monetization_risk": (flag(_c("days_since_last_purchase") > 90) * 2 + (F.lit(1) - _c("is_spender"))) / F.lit(3),
    })
    return df.withColumn("overall_risk_score", overall_risk())
