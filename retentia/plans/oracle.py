"""DuckDB twins of the shared frames, for the correctness gate.

Plain SQL over the pre-registered views (``events``, ``nation``); each query's
twin is ``WITH <these CTEs> SELECT ...``.  Doubles are rounded to 6 decimals with
IEEE arithmetic, ``floor(x * 1e6 + 0.500244140625) / 1e6``, on both sides.
"""

from __future__ import annotations

from retentia.sources.panel import ARCHETYPES, PLATFORMS

DOUBLE, BIGINT, INT, TEXT, TS = "double", "bigint", "int", "text", "ts"


_OFFSET = repr(0.5 + 2.0 ** -12)  # twin of retentia.functions.columns.ROUND_OFFSET


def r6(expr: str) -> str:
    return rnd(expr, 6)


def rnd(expr: str, digits: int) -> str:
    m = f"1e{digits}"
    e = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({e}) * {m} < 9007199254740992.0 THEN floor({e} * {m} + {_OFFSET}) / {m} ELSE {e} END)"


def clip01(expr: str) -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(greatest(CAST({expr} AS DOUBLE), 0.0), 1.0) END)"


def cap1(expr: str) -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(CAST({expr} AS DOUBLE), 1.0) END)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def score9(expr: str) -> str:
    return rnd(expr, 9)


def band(expr: str) -> str:
    return (f"(CASE WHEN ({expr}) < 0.3 THEN 'Low' WHEN ({expr}) < 0.7 THEN 'Medium' "
            f"WHEN ({expr}) IS NOT NULL THEN 'High' END)")


def band_cut(expr: str) -> str:
    return (f"(CASE WHEN ({expr}) > 0 AND ({expr}) <= 0.3 THEN 'Low' "
            f"WHEN ({expr}) > 0.3 AND ({expr}) <= 0.7 THEN 'Medium' "
            f"WHEN ({expr}) > 0.7 AND ({expr}) <= 1.0 THEN 'High' END)")


def spend_segment(expr: str) -> str:
    return (f"(CASE WHEN ({expr}) > -0.1 AND ({expr}) <= 0 THEN 'Non-Spender' "
            f"WHEN ({expr}) > 0 AND ({expr}) <= 10 THEN 'Low Spender' "
            f"WHEN ({expr}) > 10 AND ({expr}) <= 50 THEN 'Medium Spender' "
            f"WHEN ({expr}) > 50 THEN 'High Spender' END)")


def unit_hash(*parts: str) -> str:
    """Twin of ``retentia.functions.hashing.unit_hash``; parts are SQL expressions."""
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---------------------------------------------------------------- column catalogue
PANEL_COLUMNS = {
    "player_id": BIGINT, "date": TS, "registration_date": TS, "archetype": TEXT, "platform": TEXT,
    "country": TEXT, "sessions_per_week": BIGINT, "avg_session_length_mins": DOUBLE,
    "days_since_last_login": BIGINT, "session_decay_rate": DOUBLE, "win_rate": DOUBLE, "kd_ratio": DOUBLE,
    "current_rank": BIGINT, "rank_change": BIGINT, "friends_online": BIGINT, "party_play_percentage": DOUBLE,
    "toxicity_reports_received": BIGINT, "monthly_spent": DOUBLE, "days_since_last_purchase": BIGINT,
    "purchase_frequency": BIGINT, "achievements_unlocked": BIGINT, "content_completion_pct": DOUBLE,
    "feature_adoption_pct": DOUBLE, "churned": INT,
}

FEATURE_COLUMNS = {
    "account_age_days": BIGINT, "day_of_week": INT, "month": INT, "is_weekend": INT,
    "total_playtime_hours": DOUBLE, "activity_consistency": DOUBLE, "engagement_score": DOUBLE,
    "sessions_per_week_rolling_3m": DOUBLE, "avg_session_length_mins_rolling_3m": DOUBLE,
    "sessions_trend": DOUBLE, "performance_score": DOUBLE, "skill_improving": INT, "skill_declining": INT,
    "win_rate_std": DOUBLE, "social_engagement": DOUBLE, "low_social_engagement": INT, "solo_player": INT,
    "has_toxicity_issues": INT, "total_spent": DOUBLE, "spending_rolling_3m": DOUBLE, "is_spender": INT,
    "is_whale": INT, "recent_spender": INT, "spending_velocity": DOUBLE, "avg_transaction_value": DOUBLE,
    "spending_trend": DOUBLE, "content_engagement": DOUBLE, "achievement_velocity": DOUBLE,
    "content_exhausted": INT, "activity_risk": DOUBLE, "engagement_risk": DOUBLE, "monetization_risk": DOUBLE,
    "overall_risk_score": DOUBLE, "performance_engagement": DOUBLE, "social_spending": DOUBLE,
    "activity_monetization": DOUBLE,
}

ALL_FEATURE_TABLE = {**PANEL_COLUMNS, **FEATURE_COLUMNS}


def select_rounded(columns: dict[str, str], alias: str = "") -> str:
    """A select list that rounds the double columns."""
    pre = f"{alias}." if alias else ""
    return ", ".join(r6(f"{pre}{c}") + f" AS {c}" if t == DOUBLE else f"{pre}{c}" for c, t in columns.items())


# ---------------------------------------------------------------- CTEs
_EVENT_TYPES = ("view", "click", "purchase", "signup", "error")

PANEL_CTE = f"""
ev AS (
  SELECT user_id AS player_id, ts, event_type, value,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id,
         CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INTEGER) AS week
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
pw AS (
  SELECT player_id, week,
         CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) AS date,
         min(ts) AS first_ts,
         count(*) AS n,
         avg(value) AS avg_value,
         max({{'t': ts, 'e': event_id, 'k': k}}).k AS last_k,
         CAST(sum(k) AS BIGINT) AS sum_k,
         max(k) AS max_k,
         count(*) FILTER (WHERE k >= 95) AS n_k95,
         sum(value) FILTER (WHERE event_type = 'purchase') AS purchase_value,
         min(k) FILTER (WHERE event_type = 'purchase') AS min_purchase_k,
         {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in _EVENT_TYPES)}
  FROM ev GROUP BY player_id, week
),
pwt AS (
  SELECT *, {" + ".join(f"CAST(n_{t} > 0 AS INTEGER)" for t in _EVENT_TYPES)} AS n_types FROM pw
),
panel AS (
  SELECT pw.player_id AS player_id,
         date,
         min(first_ts) OVER (PARTITION BY pw.player_id) AS registration_date,
         ({_list(ARCHETYPES)})[CAST(pw.player_id % 5 AS INTEGER) + 1] AS archetype,
         ({_list(PLATFORMS)})[CAST(pw.player_id % 3 AS INTEGER) + 1] AS platform,
         nat.n_name AS country,
         n AS sessions_per_week,
         avg_value AS avg_session_length_mins,
         CAST(last_k % 31 AS BIGINT) AS days_since_last_login,
         coalesce(CAST(lag(n) OVER w - n AS DOUBLE) / CAST(greatest(lag(n) OVER w, 1) AS DOUBLE), 0.0)
           AS session_decay_rate,
         CAST(n_click AS DOUBLE) / nullif(CAST(n_click + n_error AS DOUBLE), 0) AS win_rate,
         CAST(n_view AS DOUBLE) / CAST(greatest(n_error, 1) AS DOUBLE) AS kd_ratio,
         CAST(sum_k % 100 + 1 AS BIGINT) AS current_rank,
         CAST(coalesce(sum_k % 100 - lag(sum_k % 100) OVER w, 0) AS BIGINT) AS rank_change,
         n_signup AS friends_online,
         CAST(n_view AS DOUBLE) / CAST(n AS DOUBLE) AS party_play_percentage,
         n_k95 AS toxicity_reports_received,
         coalesce(purchase_value, 0.0) AS monthly_spent,
         coalesce(CAST(min_purchase_k AS BIGINT) * 2, 180) AS days_since_last_purchase,
         n_purchase AS purchase_frequency,
         CAST(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS achievements_unlocked,
         CAST(max_k AS DOUBLE) / 99.0 AS content_completion_pct,
         CAST(n_types AS DOUBLE) / 5.0 AS feature_adoption_pct,
         CAST(last_value(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <= 3 AS INTEGER)
           AS churned
  FROM pwt pw LEFT JOIN nation nat ON CAST(nat.n_nationkey AS BIGINT) = pw.player_id % 25
  WINDOW w AS (PARTITION BY pw.player_id ORDER BY date)
)"""

_W3 = "OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"

FEATURES_CTE = PANEL_CTE + f""",
f1 AS (
  SELECT *,
    CAST(floor(CAST(date_diff('microsecond', registration_date, date) AS DOUBLE) / 86400000000.0) AS BIGINT)
      AS account_age_days,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
    CAST(month(date) AS INTEGER) AS month,
    sessions_per_week * avg_session_length_mins * 4 / 60 AS total_playtime_hours,
    1 - {clip01("session_decay_rate")} AS activity_consistency,
    {clip01("sessions_per_week / 20 * 0.3 + avg_session_length_mins / 120 * 0.3 + (1 - days_since_last_login / 30) * 0.4")}
      AS engagement_score,
    avg(sessions_per_week) {_W3} AS sessions_per_week_rolling_3m,
    avg(avg_session_length_mins) {_W3} AS avg_session_length_mins_rolling_3m,
    win_rate * 0.5 + {clip01("kd_ratio / 3")} * 0.3 + current_rank / 100 * 0.2 AS performance_score,
    {flag("rank_change > 0")} AS skill_improving,
    {flag("rank_change < -5")} AS skill_declining,
    coalesce(stddev_samp(win_rate) {_W3}, 0.0) AS win_rate_std,
    {clip01("friends_online / 15")} * 0.6 + party_play_percentage * 0.4 AS social_engagement,
    {flag("friends_online < 2")} AS low_social_engagement,
    {flag("party_play_percentage < 0.2")} AS solo_player,
    {flag("toxicity_reports_received > 0")} AS has_toxicity_issues,
    CASE WHEN monthly_spent IS NULL THEN NULL
         ELSE sum(monthly_spent) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS total_spent,
    avg(monthly_spent) {_W3} AS spending_rolling_3m,
    monthly_spent * purchase_frequency AS spending_velocity,
    monthly_spent / (purchase_frequency + 1) AS avg_transaction_value,
    content_completion_pct * 0.4 + feature_adoption_pct * 0.3 + {clip01("achievements_unlocked / 100")} * 0.3
      AS content_engagement,
    coalesce(CAST(achievements_unlocked - lag(achievements_unlocked) OVER w AS DOUBLE), 0.0) AS achievement_velocity
  FROM panel
  WINDOW w AS (PARTITION BY player_id ORDER BY date)
),
f2 AS (
  SELECT *,
    {flag("day_of_week IN (5, 6)")} AS is_weekend,
    sessions_per_week / (sessions_per_week_rolling_3m + 0.1) AS sessions_trend,
    {flag("total_spent > 0")} AS is_spender,
    {flag("total_spent > 500")} AS is_whale,
    {flag("days_since_last_purchase < 30")} AS recent_spender,
    monthly_spent / (spending_rolling_3m + 0.1) AS spending_trend,
    {flag("content_completion_pct > 0.9 AND achievement_velocity < 1")} AS content_exhausted
  FROM f1
),
f3 AS (
  SELECT *,
    ({flag("sessions_per_week < 2")} * 3 + {flag("days_since_last_login > 14")} * 3
      + {flag("session_decay_rate > 0.3")} * 2) / 8 AS activity_risk,
    ({flag("engagement_score < 0.3")} * 2 + low_social_engagement * 2 + content_exhausted) / 5 AS engagement_risk,
    ({flag("days_since_last_purchase > 90")} * 2 + {flag("spending_trend < 0.5")} + (1 - is_spender)) / 4
      AS monetization_risk
  FROM f2
),
feat AS (
  SELECT *,
    activity_risk * 0.4 + engagement_risk * 0.3 + monetization_risk * 0.3 AS overall_risk_score,
    performance_score * engagement_score AS performance_engagement,
    social_engagement * spending_velocity AS social_spending,
    sessions_per_week * monthly_spent AS activity_monetization
  FROM f3
)"""


def _latest_select(columns: dict[str, str], src: str) -> str:
    items = ["player_id", "max(date) AS date"]
    for c in columns:
        if c in ("player_id", "date"):
            continue
        items.append(f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}")
    return f"SELECT {', '.join(items)} FROM {src} GROUP BY player_id"


LATEST_CTE = FEATURES_CTE + f""",
latest AS ({_latest_select(ALL_FEATURE_TABLE, "feat")})"""

SCORED_CTE = LATEST_CTE + f""",
scored AS (
  SELECT *, {score9("overall_risk_score")} AS churn_risk_score,
         {band(score9("overall_risk_score"))} AS risk_category
  FROM latest
)"""


def with_panel(select: str) -> str:
    return f"WITH {PANEL_CTE}\n{select}"


def with_features(select: str) -> str:
    return f"WITH {FEATURES_CTE}\n{select}"


def with_latest(select: str) -> str:
    return f"WITH {LATEST_CTE}\n{select}"


def with_scored(select: str) -> str:
    return f"WITH {SCORED_CTE}\n{select}"


# ---------------------------------------------------------------- statistics twins
def erfc_nonneg(x: str) -> str:
    """erfc(x) for x >= 0 as 1 minus Simpson's rule on 2 / sqrt(pi) * exp(-t^2) over 2,000 steps (not the code's formula)."""
    w = "CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return (f"(1.0 - 1.1283791670955126::DOUBLE * ({x}) / 6000.0 * (SELECT sum({w} * exp(-power(({x}) * i / 2000.0, 2))) "
            f"FROM range(0, 2001) t(i)))")
