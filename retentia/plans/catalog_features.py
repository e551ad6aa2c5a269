"""Registered queries: panel, features, snapshot, joins, risk and money (S1, F, W, P4-P7, J, K, A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.columns import score9
from retentia.operators import features as feat
from retentia.operators import joins, risk, snapshot
from retentia.plans import frames
from retentia.plans import oracle as O
from retentia.plans.registry import query
from retentia.sources import panel as src
from retentia.sources.sinks import materialize

KEYS = ("player_id", "date")


def D(x: float) -> str:
    """A DOUBLE literal in DuckDB (bare decimals there are DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _cols(names, types=O.ALL_FEATURE_TABLE) -> dict[str, str]:
    return {n: types[n] for n in names}


# ---------------------------------------------------------------- S1 / panel
@query("panel", "S1 S13 panel-from-events", O.with_panel(f"SELECT {O.select_rounded(O.PANEL_COLUMNS)} FROM panel"))
def q_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The player panel derived from the event log (typed per the declared schema)."""
    return frames.panel(spark, sf)


# ---------------------------------------------------------------- F1-F30 per stage
STAGE_COLUMNS = {
    "time": ["account_age_days", "day_of_week", "month", "is_weekend"],
    "behaviour": ["total_playtime_hours", "activity_consistency", "engagement_score",
                  "sessions_per_week_rolling_3m", "avg_session_length_mins_rolling_3m", "sessions_trend"],
    "performance": ["performance_score", "skill_improving", "skill_declining", "win_rate_std"],
    "social": ["social_engagement", "low_social_engagement", "solo_player", "has_toxicity_issues"],
    "money": ["total_spent", "spending_rolling_3m", "is_spender", "is_whale", "recent_spender",
              "spending_velocity", "avg_transaction_value", "spending_trend"],
    "content": ["content_engagement", "achievement_velocity", "content_exhausted"],
    "risk": ["activity_risk", "engagement_risk", "monetization_risk", "overall_risk_score"],
    "interactions": ["performance_engagement", "social_spending", "activity_monetization"],
}
STAGE_IDS = {
    "time": "F1 F2 F3 F4", "behaviour": "F5 F6 F7 F8 W1", "performance": "F9 F10 F11 W3",
    "social": "F12 F13 F14 F15", "money": "F16 F17 F18 F19 F20 F21 W2 W4", "content": "F22 F23 W5",
    "risk": "F24 F25 F26 F27", "interactions": "F28 F29 F30",
}


def _register_stage(i: int, stage_name: str) -> None:
    cols = STAGE_COLUMNS[stage_name]
    sql = O.with_features(f"SELECT {O.select_rounded(_cols([*KEYS, *cols]))} FROM feat")

    def build(spark: SparkSession, sf: str) -> DataFrame:
        df = frames.panel(spark, sf)
        for stage in feat.STAGES[: i + 1]:
            df = df.transform(stage)
        return df.select(*KEYS, *cols)

    build.__doc__ = f"Feature stage '{stage_name}' on the panel (with the stages it reads)."
    query(f"features_{stage_name}", STAGE_IDS[stage_name], sql)(build)


for _i, _s in enumerate(STAGE_COLUMNS):
    _register_stage(_i, _s)


@query("features_all", "F32 W1-W6", O.with_features(f"SELECT {O.select_rounded(O.ALL_FEATURE_TABLE)} FROM feat"))
def q_features_all(spark, sf):
    """All eight stages in order: the engineered panel."""
    return frames.features(spark, sf)


SERVE_COLUMNS = {
    "total_playtime_hours": O.DOUBLE, "activity_consistency": O.DOUBLE, "engagement_score": O.DOUBLE,
    "performance_score": O.DOUBLE, "skill_improving": O.INT, "skill_declining": O.INT,
    "social_engagement": O.DOUBLE, "low_social_engagement": O.INT, "solo_player": O.INT,
    "has_toxicity_issues": O.INT, "is_spender": O.INT, "recent_spender": O.INT, "spending_velocity": O.DOUBLE,
    "avg_transaction_value": O.DOUBLE, "content_engagement": O.DOUBLE, "activity_risk": O.DOUBLE,
    "engagement_risk": O.DOUBLE, "monetization_risk": O.DOUBLE, "overall_risk_score": O.DOUBLE,
}

def _serve_ctes(source: str, more: str = "") -> str:
    """CTEs up to ``s3``: the request-time features of the rows of ``source``; ``more`` names columns to pass on."""
    return f"""d AS (
  SELECT player_id{more}, sessions_per_week AS s, avg_session_length_mins AS len, days_since_last_login AS idle,
    coalesce(session_decay_rate, 0.0) AS decay, coalesce(win_rate, 0.5) AS win, coalesce(kd_ratio, 1.0) AS kd,
    coalesce(current_rank, 50) AS rnk, coalesce(rank_change, 0) AS rchg, coalesce(friends_online, 0) AS friends,
    coalesce(party_play_percentage, 0.0) AS party, coalesce(toxicity_reports_received, 0) AS reports,
    coalesce(monthly_spent, 0.0) AS spend, coalesce(days_since_last_purchase, 180) AS dslp,
    coalesce(purchase_frequency, 0) AS freq, coalesce(achievements_unlocked, 0) AS ach,
    coalesce(content_completion_pct, 0.0) AS completion, coalesce(feature_adoption_pct, 0.0) AS adoption
  FROM {source}
),
s1 AS (
  SELECT player_id{more}, s, idle, decay, dslp, friends, spend,
    s * len * 4 / 60 AS total_playtime_hours,
    1 - {O.cap1("decay")} AS activity_consistency,
    least(1.0, greatest(0.0, s / 20 * {D(0.3)} + len / 120 * {D(0.3)} + (1 - idle / 30) * {D(0.4)})) AS engagement_score,
    win * {D(0.5)} + {O.cap1("kd / 3")} * {D(0.3)} + rnk / 100 * {D(0.2)} AS performance_score,
    {O.flag("rchg > 0")} AS skill_improving,
    {O.flag("rchg < -5")} AS skill_declining,
    {O.cap1("friends / 15")} * {D(0.6)} + party * {D(0.4)} AS social_engagement,
    {O.flag("friends < 2")} AS low_social_engagement,
    {O.flag("party < 0.2")} AS solo_player,
    {O.flag("reports > 0")} AS has_toxicity_issues,
    {O.flag("spend > 0")} AS is_spender,
    {O.flag("dslp < 30")} AS recent_spender,
    spend * freq AS spending_velocity,
    spend / greatest(freq, 1) AS avg_transaction_value,
    completion * {D(0.4)} + adoption * {D(0.3)} + {O.cap1("ach / 100")} * {D(0.3)} AS content_engagement,
    ({O.flag("s < 2")} * 3 + {O.flag("idle > 14")} * 3 + {O.flag("decay > 0.3")} * 2) / 8 AS activity_risk
  FROM d
),
s2 AS (
  SELECT *,
    ({O.flag("engagement_score < 0.3")} * 2 + low_social_engagement * 2) / 4 AS engagement_risk,
    ({O.flag("dslp > 90")} * 2 + (1 - is_spender)) / 3 AS monetization_risk
  FROM s1
),
s3 AS (SELECT *, activity_risk * {D(0.4)} + engagement_risk * {D(0.3)} + monetization_risk * {D(0.3)} AS overall_risk_score
       FROM s2)"""


def served_rows_sql(source: str, name: str) -> str:
    """CTEs up to ``name``: what a model and the risk factors read of each request row of ``source``, by its date."""
    return f"""{_serve_ctes(source, ", date")}, {name} AS (
  SELECT player_id, date, overall_risk_score, engagement_score, friends AS friends_online, idle AS days_since_last_login,
    decay AS session_decay_rate, spend AS monthly_spent, s AS sessions_per_week, dslp AS days_since_last_purchase FROM s3)"""


_SERVE_SQL = O.with_panel(f"""
, raw AS ({O._latest_select(O.PANEL_COLUMNS, "panel")}), {_serve_ctes("raw")}
SELECT player_id, {O.select_rounded(SERVE_COLUMNS)} FROM s3""")


@query("serve_features", "F31", _SERVE_SQL)
def q_serve_features(spark, sf):
    """Request-time feature set on each player's latest raw row (defaults for absent values)."""
    raw = frames.latest(spark, sf).select(*O.PANEL_COLUMNS)  # the latest row's raw measures
    return feat.serve_features(raw).select("player_id", *SERVE_COLUMNS)


# ---------------------------------------------------------------- W7 / W8 / L1 / P7
@query("latest_snapshot", "W7", O.with_latest(f"SELECT {O.select_rounded(O.ALL_FEATURE_TABLE)} FROM latest"))
def q_latest(spark, sf):
    """Last non-null value of every feature column per player."""
    return frames.latest(spark, sf)


@query("first_last_per_player", "W8", O.with_panel(
    "SELECT player_id, arg_min(archetype, date) FILTER (WHERE archetype IS NOT NULL) AS first_archetype, "
    "arg_min(sessions_per_week, date) FILTER (WHERE sessions_per_week IS NOT NULL) AS first_sessions_per_week, "
    "arg_max(churned, date) FILTER (WHERE churned IS NOT NULL) AS last_churned, "
    "arg_max(sessions_per_week, date) FILTER (WHERE sessions_per_week IS NOT NULL) AS last_sessions_per_week "
    "FROM panel GROUP BY player_id"))
def q_first_last(spark, sf):
    """First archetype / sessions and last label / sessions per player."""
    return snapshot.first_last(frames.features(spark, sf), first=["archetype", "sessions_per_week"],
                               last=["churned", "sessions_per_week"])


def _model_input_sql() -> str:
    cols = [c for c in O.ALL_FEATURE_TABLE if c not in snapshot.NON_FEATURE_COLUMNS]
    items = []
    for c in cols:
        t = O.ALL_FEATURE_TABLE[c]
        if t == O.DOUBLE:
            items.append(O.r6(f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END") + f" AS {c}")
        else:
            items.append(f"coalesce({c}, 0) AS {c}")
    return O.with_latest(f"SELECT player_id, date, churned, {', '.join(items)} FROM latest")


@query("model_input", "L1 P4 P6", _model_input_sql())
def q_model_input(spark, sf):
    """Latest snapshot → feature columns → null / NaN / inf to 0."""
    data, cols = snapshot.prepare_model_data(frames.features(spark, sf))
    return data.select("player_id", "date", "churned", *cols)


# A model feature list with one name the frame lacks (filled with 0).
ALIGN_NAMES = ["sessions_per_week", "engagement_score", "overall_risk_score", "total_spent", "unknown_feature"]


@query("align_features", "P7", O.with_latest(
    "SELECT player_id, sessions_per_week, " + O.r6("engagement_score") + " AS engagement_score, "
    + O.r6("overall_risk_score") + " AS overall_risk_score, " + O.r6("total_spent") + " AS total_spent, "
    "CAST(0.0 AS DOUBLE) AS unknown_feature FROM latest"))
def q_align(spark, sf):
    """Columns in model order; a missing one becomes 0.0."""
    return snapshot.align_features(frames.latest(spark, sf), ALIGN_NAMES)


# ---------------------------------------------------------------- J1-J5
@query("assemble_panel", "J1", O.with_panel(
    "SELECT player_id, week, n, " + O.r6("avg_value") + " AS avg_value, n_click, n_error, n_signup, "
    + O.r6("coalesce(purchase_value, 0.0)") + " AS purchase_value, n_purchase, max_k FROM pw"))
def q_assemble(spark, sf):
    """Attribute groups of one written measures table (the log is read once), inner-joined on the panel key."""
    measures = materialize(src.player_week_measures(src.table(spark, sf, "events")))
    group = lambda *cols: measures.select("player_id", "week", *cols)
    money = group(F.coalesce("purchase_value", F.lit(0.0)).alias("purchase_value"), "n_purchase")
    return joins.assemble_panel(group("n", "avg_value"), group("n_click", "n_error"), group("n_signup"), money, group("max_k"),
                                keys=("player_id", "week"))


@query("join_profile", "J2", O.with_panel(
    "SELECT p.player_id, p.date, p.sessions_per_week, pr.archetype, pr.country, pr.platform, pr.registration_date "
    "FROM panel p JOIN (SELECT player_id, min(archetype) AS archetype, min(country) AS country, "
    "min(platform) AS platform, min(registration_date) AS registration_date FROM panel GROUP BY player_id) pr "
    "ON p.player_id = pr.player_id"))
def q_join_profile(spark, sf):
    """Panel measures joined to the one-row-per-player profile dimension (built from the event log)."""
    measures = frames.features(spark, sf).select("player_id", "date", "sessions_per_week")
    profiles = src.profiles_from_events(src.table(spark, sf, "events"), src.table(spark, sf, "nation"))
    return joins.join_profile(measures, profiles).select(
        "player_id", "date", "sessions_per_week", "archetype", "country", "platform", "registration_date")


@query("join_predictions", "J4 K1a", O.with_scored(
    "SELECT l.player_id, l.sessions_per_week, s.churn_risk_score, s.risk_category FROM latest l "
    "LEFT JOIN (SELECT player_id, churn_risk_score, risk_category FROM scored) s "
    "ON l.player_id = s.player_id"))
def q_join_predictions(spark, sf):
    """Latest snapshot left-joined to a prediction table."""
    lat = frames.latest(spark, sf)
    preds = frames.with_score(lat)
    return joins.join_predictions(lat.select("player_id", "sessions_per_week"), preds)


@query("fallback_scores", "J5 K1b", O.with_latest(
    f"SELECT player_id, CAST(churned AS DOUBLE) AS churn_risk_score, {O.band_cut(O.score9('CAST(churned AS DOUBLE)'))}"
    " AS risk_category FROM latest"))
def q_fallback(spark, sf):
    """No predictions: the label is the score; right-closed bins leave retained players without a band."""
    return joins.fallback_scores(frames.latest(spark, sf)).select("player_id", "churn_risk_score", "risk_category")


# ---------------------------------------------------------------- K1-K9, A1
@query("risk_distribution", "K1a A3", O.with_scored(
    "SELECT risk_category, count(*) AS players FROM scored GROUP BY risk_category"))
def q_risk_distribution(spark, sf):
    """How many players are in each risk band now (left-closed bands on the latest risk score)."""
    return frames.scored(spark, sf).groupBy("risk_category").agg(F.count(F.lit(1)).alias("players"))


@query("risk_band_edges", "K1a K1b", O.with_latest(
    f"SELECT player_id, {O.r6(O.score9('overall_risk_score'))} AS score, {O.band(O.score9('overall_risk_score'))} "
    f"AS band_left_closed, {O.band_cut(O.score9('overall_risk_score'))} AS band_right_closed FROM latest"))
def q_band_edges(spark, sf):
    """Both band conventions side by side (they differ at 0, 0.3 and 0.7)."""
    s = score9("overall_risk_score")
    return frames.latest(spark, sf).select("player_id", s.alias("score"), risk.risk_band(s).alias("band_left_closed"),
                                           risk.risk_band_cut(s).alias("band_right_closed"))


def _factor_sql() -> str:
    parts = []
    for name, impact, c, _ in risk.RISK_FACTOR_RULES:
        op = {"Low Session Frequency": "< 2", "Inactive Player": "> 14", "Declining Engagement": "> 0.3",
              "Low Social Connection": "< 2", "No Recent Purchases": "> 90"}[name]
        parts.append(f"SELECT player_id, '{name}' AS factor, {D(impact)} AS impact, CAST({c} AS DOUBLE) AS value "
                     f"FROM latest WHERE {c} {op}")
    u = " UNION ALL ".join(parts)
    return O.with_latest(
        f"SELECT player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY impact DESC) AS INTEGER) "
        f"AS factor_rank, factor, {O.r6('impact')} AS impact, {O.r6('value')} AS value FROM ({u}) t")


@query("risk_factors", "K2", _factor_sql())
def q_risk_factors(spark, sf):
    """Rule-based risk factors per player, ranked by impact (exploded)."""
    return risk.risk_factor_rows(frames.latest(spark, sf))


@query("spending_segments", "K3 K4", O.with_latest(
    f"SELECT player_id, {O.r6('monthly_spent')} AS monthly_spent, {O.spend_segment('monthly_spent')} AS "
    f"spending_segment, {O.r6('monthly_spent * 12')} AS ltv FROM latest"))
def q_spending(spark, sf):
    """Spending segment (right-closed bins) and 12-month lifetime value per player."""
    lat = frames.latest(spark, sf)
    return lat.select("player_id", "monthly_spent", risk.spending_segment(F.col("monthly_spent")).alias(
        "spending_segment"), risk.ltv(F.col("monthly_spent")).alias("ltv"))


def _intervention_sql(select: str) -> str:
    parts = []
    conds = ["sessions_per_week < 2", "friends_online < 2", "monthly_spent = 0", "content_completion_pct > 0.8"]
    for (name, impact, _), cond in zip(risk.INTERVENTIONS, conds):
        parts.append(f"SELECT player_id, '{name}' AS intervention, '{impact}' AS expected_impact FROM scored "
                     f"WHERE risk_category = 'High' AND {cond}")
    return O.with_scored(f", tg AS ({' UNION ALL '.join(parts)}) {select}")


@query("intervention_targets", "K5", _intervention_sql("SELECT * FROM tg"))
def q_interventions(spark, sf):
    """High-band players tagged with each campaign they qualify for."""
    return risk.intervention_targets(frames.scored(spark, sf))


@query("intervention_counts", "K5", _intervention_sql(
    "SELECT intervention, expected_impact, count(*) AS players FROM tg GROUP BY intervention, expected_impact"))
def q_intervention_counts(spark, sf):
    """Players per campaign among the High band."""
    return risk.intervention_counts(frames.scored(spark, sf))


@query("priority_queue", "K6 K0b K4", O.with_scored(f"""
, high AS (SELECT *, monthly_spent * 12 AS ltv FROM scored WHERE risk_category = 'High'),
pq AS (SELECT player_id, churn_risk_score, ltv,
  churn_risk_score * {D(0.5)} + (ltv / nullif((SELECT max(ltv) FROM high), 0)) * {D(0.3)} + engagement_score * {D(0.2)}
    AS priority_score, sessions_per_week, days_since_last_login FROM high)
SELECT player_id, {O.r6('churn_risk_score')} AS churn_risk_score, {O.r6('ltv')} AS ltv,
  {O.r6('priority_score')} AS priority_score, sessions_per_week, days_since_last_login
FROM pq ORDER BY priority_score DESC NULLS LAST, player_id LIMIT 20"""))
def q_priority(spark, sf):
    """Top 20 High-band players by priority (score, relative LTV, engagement)."""
    return risk.priority_queue(frames.scored(spark, sf), n=20)


def _roi_sql(inner: str, cost: str, lift: str, extra_cols: str) -> str:
    return f"""
SELECT {extra_cols},
  {O.r6('player_ltv')} AS player_ltv, {O.r6('players_saved')} AS players_saved,
  {O.r6('revenue_retained')} AS revenue_retained, {O.r6('total_cost')} AS total_cost,
  {O.r6('net_benefit')} AS net_benefit, {O.r6('roi_pct')} AS roi_pct, {O.r6('breakeven_players')} AS breakeven_players
FROM (SELECT *, CASE WHEN total_cost > 0 THEN net_benefit / total_cost * 100.0 ELSE 0.0 END AS roi_pct,
        total_cost / nullif(player_ltv, 0) AS breakeven_players
      FROM (SELECT *, revenue_retained - total_cost AS net_benefit
            FROM (SELECT *, players_saved * player_ltv AS revenue_retained, players_targeted * {cost} AS total_cost
                  FROM (SELECT *, avg_monthly_spend * {D(12)} AS player_ltv, players_targeted * {lift} AS players_saved
                        FROM ({inner}) a0) a1) a2) a3) a4"""


_ROI_AGG = "SELECT risk_category, count(*) AS players_targeted, avg(monthly_spent) AS avg_monthly_spend FROM scored " \
           "GROUP BY risk_category"


@query("roi_projection", "K7", O.with_scored(_roi_sql(
    _ROI_AGG, D(5.0), D(0.15), f"risk_category, players_targeted, {O.r6('avg_monthly_spend')} AS avg_monthly_spend")))
def q_roi(spark, sf):
    """Return on a retention campaign per risk band (cost 5, lift 15 %, 12 months)."""
    return risk.roi_projection(frames.scored(spark, sf))


def _sens_sql() -> str:
    grid = ", ".join(f"({D(c)}, {D(l)})" for c in risk.SENSITIVITY_COSTS for l in risk.SENSITIVITY_LIFTS)
    return O.with_scored(f"""
, agg AS ({_ROI_AGG}),
grid AS (SELECT * FROM (VALUES {grid}) g(cost_per_player, lift)),
x AS (SELECT risk_category, cost_per_player, lift, players_targeted * lift * (avg_monthly_spend * {D(12)}) AS revenue,
        players_targeted * cost_per_player AS cost FROM agg, grid)
SELECT risk_category, cost_per_player, lift,
  {O.r6('CASE WHEN cost > 0 THEN (revenue - cost) / cost * 100.0 ELSE 0.0 END')} AS roi_pct FROM x""")


@query("roi_sensitivity", "K8", _sens_sql())
def q_sensitivity(spark, sf):
    """ROI % over 6 lifts x 6 costs per risk band."""
    return risk.roi_sensitivity(frames.scored(spark, sf))


def _k9_expr() -> str:
    terms = [("sessions_per_week < 1", 0.3), ("days_since_last_login > 14", 0.3), ("session_decay_rate > 0.5", 0.2),
             ("friends_online < 2", 0.1), ("days_since_last_purchase > 90", 0.1)]
    p = D(0.0)
    for cond, v in terms:
        p = f"({p} + CASE WHEN coalesce({cond}, false) THEN {D(v)} ELSE {D(0.0)} END)"
    p = f"({p} + CASE WHEN archetype = 'at_risk' THEN {D(0.4)} WHEN archetype = 'hardcore' THEN {D(-0.3)} ELSE {D(0.0)} END)"
    return O.r6(O.rnd(f"least(greatest({p}, 0.0), 1.0)", 4))


def _k9_sql() -> str:
    return O.with_latest(f"SELECT player_id, archetype, {_k9_expr()} AS churn_probability FROM latest")


@query("rule_churn_probability", "K9", _k9_sql())
def q_k9(spark, sf):
    """Rule-based churn probability on each player's latest row."""
    return risk.rule_churn_probability(frames.latest(spark, sf)).select("player_id", "archetype", "churn_probability")


@query("risk_summary", "A1", O.with_features(f"""
SELECT player_id, max(date) AS last_update, {O.r6('max(overall_risk_score)')} AS risk_score,
  {O.r6('avg(sessions_per_week)')} AS avg_sessions, {O.r6('avg(monthly_spent)')} AS avg_spent,
  {O.r6('max(total_spent)')} AS total_spent, max(friends_online) AS friends_count, max(platform) AS platform,
  max(archetype) AS archetype, {O.band(O.score9('max(overall_risk_score)'))} AS risk_category
FROM feat GROUP BY player_id"""))
def q_risk_summary(spark, sf):
    """The per-player risk summary view."""
    return risk.risk_summary(frames.features(spark, sf))


def _labels_sql() -> str:
    return O.with_latest(
        f"SELECT p.player_id, p.date, p.sessions_per_week, l.churned, l.churn_probability FROM panel p LEFT JOIN "
        f"(SELECT player_id, churned, {_k9_expr()} AS churn_probability FROM latest) l ON p.player_id = l.player_id")


@query("join_labels", "J3 K9", _labels_sql())
def q_join_labels(spark, sf):
    """Panel rows left-joined to the per-player label table (label + rule probability)."""
    labels = risk.rule_churn_probability(frames.latest(spark, sf)).select("player_id", "churned", "churn_probability")
    return joins.join_labels(frames.features(spark, sf).select("player_id", "date", "sessions_per_week"), labels)
