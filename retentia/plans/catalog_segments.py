"""Registered queries: filters, top-k, segment and exploration aggregates (P1, P2, P5, P8, K0a, K0e, A2-A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import segments as seg
from retentia.operators import sketches
from retentia.operators.snapshot import numeric_columns
from retentia.plans import frames
from retentia.plans import oracle as O
from retentia.plans.registry import query
from retentia.sources.panel import ARCHETYPES
from retentia.sources.sinks import materialize

RISK_FILTER = ["High", "Medium"]
PLATFORM_FILTER = ["PC", "Console"]

# Numeric columns of the latest snapshot in frame order (identity excluded), as P5 lists them.
NUMERIC_LATEST = [c for c, t in O.ALL_FEATURE_TABLE.items()
                  if t in (O.DOUBLE, O.BIGINT, O.INT) and c != "player_id"]
SCORE_CORR_COLS = [c for c in NUMERIC_LATEST if c != "churn_risk_score"][:15]


def _filtered_sql(platforms: bool = False) -> str:
    """The page's default bands; platforms only where the filter is the feature."""
    where = " AND platform IN ('PC', 'Console')" if platforms else ""
    return f", filt AS (SELECT * FROM scored WHERE risk_category IN ('High', 'Medium'){where})"


def _filtered(spark, sf, platforms: list[str] | None = None):
    return seg.filter_in(frames.scored(spark, sf), RISK_FILTER, platforms)


# ---------------------------------------------------------------- P1 / P8 / K0a
@query("high_risk_table", "P1 P8 K0a", O.with_scored(_filtered_sql(platforms=True) + f"""
SELECT player_id, {O.r6('churn_risk_score')} AS churn_risk_score, risk_category, sessions_per_week,
  days_since_last_login, {O.r6('monthly_spent')} AS monthly_spent, friends_online
FROM filt ORDER BY churn_risk_score DESC NULLS LAST, player_id LIMIT 20"""))
def q_high_risk_table(spark, sf):
    """Top 20 by risk among High/Medium players on PC or Console, display columns only."""
    top = seg.top_n_risk(_filtered(spark, sf, PLATFORM_FILTER), n=20)
    return seg.display_projection(top, list(seg.HIGH_RISK_DISPLAY))


@query("sample_players", "K0e", O.with_scored(f"""
SELECT player_id, {O.r6('churn_risk_score')} AS churn_risk_score FROM scored
ORDER BY {O.unit_hash("'42'", 'player_id')}, player_id LIMIT 100"""))
def q_sample(spark, sf):
    """Exact-size repeatable sample of 100 players (seed 42)."""
    return seg.sample_players(frames.scored(spark, sf), 100, seed=42).select("player_id", "churn_risk_score")


# ---------------------------------------------------------------- A2-A7
@query("overview_kpis", "A2", O.with_scored(f"""
SELECT count(*) AS total_players, count(*) FILTER (WHERE risk_category = 'High') AS high_risk_players,
  {O.r6("CAST(count(*) FILTER (WHERE risk_category = 'High') AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100.0")}
    AS high_risk_pct,
  {O.r6('avg(churn_risk_score)')} AS avg_risk_score, {O.r6('sum(monthly_spent)')} AS monthly_revenue
FROM scored"""))
def q_overview(spark, sf):
    """Players, high-risk count and share, mean score, monthly revenue."""
    return seg.overview_kpis(frames.scored(spark, sf))


@query("score_histogram", "A4", O.with_scored(f"""
, v AS (SELECT churn_risk_score AS s FROM scored WHERE churn_risk_score IS NOT NULL),
b AS (SELECT min(s) AS lo, max(s) AS hi FROM v),
x AS (SELECT CASE WHEN (hi - lo) / 50.0 > 0 THEN least(50, CAST(floor((s - lo) / ((hi - lo) / 50.0)) AS BIGINT) + 1)
                  ELSE 1 END AS bin, lo, hi FROM v, b)
SELECT bin, {O.r6('lo + (bin - 1) * ((hi - lo) / 50.0)')} AS bin_lo, {O.r6('lo + bin * ((hi - lo) / 50.0)')} AS bin_hi,
  count(*) AS players FROM x GROUP BY bin, lo, hi"""))
def q_histogram(spark, sf):
    """Equal-width histogram of the risk score (50 bins)."""
    return seg.score_histogram(frames.scored(spark, sf), bins=50)


@query("risk_by_archetype", "A5", O.with_scored(
    f"SELECT archetype, {O.r6('avg(churn_risk_score)')} AS avg_risk_score, count(*) AS players FROM scored "
    f"GROUP BY archetype"))
def q_risk_by_archetype(spark, sf):
    """Mean risk per archetype, highest first."""
    return seg.risk_by(frames.scored(spark, sf), "archetype")


@query("risk_by_platform", "A5", O.with_scored(
    f"SELECT platform, {O.r6('avg(churn_risk_score)')} AS avg_risk_score, count(*) AS players FROM scored "
    f"GROUP BY platform"))
def q_risk_by_platform(spark, sf):
    """Mean risk per platform."""
    return seg.risk_by(frames.scored(spark, sf), "platform")


def _factor_counts_sql(factors: list[tuple[str, str]]) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE coalesce({c}, false)) AS f{i}" for i, (_, c) in enumerate(factors))
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS factor, f{i} AS players, "
        f"{O.r6(f'coalesce(CAST(f{i} AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) * 100.0, 0.0)')} AS pct FROM w"
        for i, (name, _) in enumerate(factors))
    return O.with_scored(_filtered_sql() + f", w AS (SELECT count(*) AS n, {cols} FROM filt) {rows}")


@query("behaviour_risk_counts", "A6", _factor_counts_sql([
    ("Low Activity", "sessions_per_week < 2"), ("Inactive (>14 days)", "days_since_last_login > 14"),
    ("Declining Engagement", "session_decay_rate > 0.3")]))
def q_behaviour_counts(spark, sf):
    """Behavioural risk factors among the filtered players: count and percent."""
    return seg.behaviour_risk_counts(_filtered(spark, sf))


@query("social_risk_counts", "A7", _factor_counts_sql([
    ("Low Social Connection", "friends_online < 2"), ("Solo Player", "party_play_percentage < 0.2")]))
def q_social_counts(spark, sf):
    """Social risk factors among the filtered players: count and percent."""
    return seg.social_risk_counts(_filtered(spark, sf))


# ---------------------------------------------------------------- A8-A10
def _pearson_sql(a: str, b: str) -> str:
    x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _corr_long_sql(src: str, target: str, cols: list[str]) -> str:
    aggs = ", ".join(f"{_pearson_sql(c, target)} AS c{i}" for i, c in enumerate(cols))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, c{i} AS correlation FROM wide" for i, c in enumerate(cols))
    return f", wide AS (SELECT {aggs} FROM {src}), corr AS ({rows})"


@query("correlation_with_score", "A8 P5", O.with_scored(
    _filtered_sql() + _corr_long_sql("filt", "churn_risk_score", SCORE_CORR_COLS)
    + f" SELECT feature, {O.r6('correlation')} AS correlation FROM corr"))
def q_corr_score(spark, sf):
    """Pearson correlation of the first 15 numeric columns with the risk score (filtered players)."""
    df = _filtered(spark, sf)
    cols = numeric_columns(df, exclude=("player_id", "churn_risk_score"), limit=15)
    return seg.correlation_with(df, "churn_risk_score", cols)


CHURN_CORR_COLS = [c for c in NUMERIC_LATEST if c != "churned"]


@query("churn_correlations", "A9", O.with_latest(
    _corr_long_sql("latest", "churned", CHURN_CORR_COLS) + f"""
, nn AS (SELECT * FROM corr WHERE correlation IS NOT NULL),
top AS (SELECT feature, correlation, 'top' AS direction FROM nn ORDER BY {O.rnd('correlation', 9)} DESC, feature LIMIT 10),
bottom AS (SELECT feature, correlation, 'bottom' AS direction FROM nn ORDER BY {O.rnd('correlation', 9)} ASC, feature LIMIT 10)
SELECT feature, {O.r6('correlation')} AS correlation, direction FROM (SELECT * FROM top UNION ALL SELECT * FROM bottom)"""))
def q_churn_corr(spark, sf):
    """Ten most positive and ten most negative correlations with the churn label."""
    lat = frames.latest(spark, sf)
    return seg.churn_correlations(lat, numeric_columns(lat, exclude=("player_id",)))


# The ten columns of the correlation heat map.
MATRIX_COLS = ["sessions_per_week", "avg_session_length_mins", "days_since_last_login", "win_rate", "kd_ratio",
               "friends_online", "party_play_percentage", "monthly_spent", "achievements_unlocked", "churned"]


def _matrix_sql() -> str:
    n = len(MATRIX_COLS)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    aggs = ", ".join(f"{_pearson_sql(MATRIX_COLS[i], MATRIX_COLS[j])} AS p{i}_{j}" for i, j in pairs)
    rows = []
    for i, j in pairs:
        rows.append(f"SELECT '{MATRIX_COLS[i]}' AS feature_a, '{MATRIX_COLS[j]}' AS feature_b, p{i}_{j} AS c FROM wide")
        if i != j:
            rows.append(f"SELECT '{MATRIX_COLS[j]}' AS feature_a, '{MATRIX_COLS[i]}' AS feature_b, p{i}_{j} AS c FROM wide")
    return O.with_latest(f", wide AS (SELECT {aggs} FROM latest) SELECT feature_a, feature_b, {O.r6('c')} AS correlation "
                         f"FROM ({' UNION ALL '.join(rows)})")


@query("correlation_matrix", "A10", _matrix_sql())
def q_matrix(spark, sf):
    """All pairwise correlations of ten behaviour columns and the label."""
    return seg.correlation_matrix(frames.latest(spark, sf), MATRIX_COLS)


# ---------------------------------------------------------------- A11 / A12 / P2
def _matrix_counts_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {O.spend_segment('monthly_spent')} = '{s}') AS {seg._snake(s)}"
                     for s in seg.SPEND_SEGMENTS)
    return O.with_scored(f"SELECT risk_category, {cols} FROM scored GROUP BY risk_category")


@query("segment_matrix", "A11 K3", _matrix_counts_sql())
def q_segment_matrix(spark, sf):
    """Risk band x spending segment counts."""
    return seg.segment_matrix(frames.scored(spark, sf))


def _profile_sql(risk: str, spend: str) -> str:
    return O.with_scored(f"""
, segm AS (SELECT * FROM scored WHERE risk_category = '{risk}' AND {O.spend_segment('monthly_spent')} = '{spend}')
SELECT '{risk}' AS risk_category, '{spend}' AS spending_segment, count(*) AS segment_size,
  {O.r6(f"CAST(count(*) AS DOUBLE) / nullif(CAST((SELECT count(*) FROM scored) AS DOUBLE), 0) * 100.0")} AS pct_of_total,
  {O.r6('avg(sessions_per_week)')} AS avg_sessions, {O.r6('avg(avg_session_length_mins)')} AS avg_session_length,
  {O.r6('avg(days_since_last_login)')} AS avg_days_since_login, {O.r6('avg(friends_online)')} AS avg_friends_online
FROM segm""")


@query("segment_profile", "A12 P2", _profile_sql("High", "Non-Spender"))
def q_segment_profile(spark, sf):
    """Size, share and mean activity of the High-risk non-spenders (the page's default selection)."""
    return seg.segment_profile(frames.scored(spark, sf), "High", "Non-Spender")


# ---------------------------------------------------------------- A13-A18
@query("churn_by_archetype", "A13", O.with_latest(
    f"SELECT archetype, {O.r6('avg(churned) * 100.0')} AS churn_rate_pct, count(*) AS players FROM latest "
    f"GROUP BY archetype"))
def q_churn_by_archetype(spark, sf):
    """Churn percent and player count per archetype."""
    return seg.churn_by_archetype(frames.latest(spark, sf))


@query("churn_overview", "A14", O.with_latest(
    f"SELECT count(*) AS total_players, CAST(sum(churned) AS BIGINT) AS churned_players, "
    f"{O.r6('avg(churned)')} AS churn_rate, "
    + ", ".join(f"count(*) FILTER (WHERE archetype = '{a}') AS n_{a}" for a in ARCHETYPES) + " FROM latest"))
def q_churn_overview(spark, sf):
    """Players, churned, churn rate and archetype counts."""
    return seg.churn_overview(frames.latest(spark, sf))


def _hist_sql() -> str:
    feats = seg.HISTOGRAM_FEATURES
    rows = " UNION ALL ".join(f"SELECT churned, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM latest" for f in feats)
    return O.with_latest(f"""
, lng AS (SELECT * FROM ({rows}) WHERE x IS NOT NULL),
bnd AS (SELECT feature, churned, min(x) AS lo, max(x) AS hi FROM lng GROUP BY feature, churned),
j AS (SELECT l.feature, l.churned, l.x, b.lo, b.hi, (b.hi - b.lo) / 30.0 AS w
      FROM lng l JOIN bnd b ON l.feature = b.feature AND l.churned = b.churned),
k AS (SELECT feature, churned, lo, w,
        CASE WHEN w > 0 THEN least(30, CAST(floor((x - lo) / w) AS BIGINT) + 1) ELSE 1 END AS bin FROM j)
SELECT feature, CASE feature {" ".join(f"WHEN '{f}' THEN '{f.replace('_', ' ').title()}'" for f in feats)} END AS title,
  churned, bin, {O.r6('lo + (bin - 1) * w')} AS bin_lo, {O.r6('lo + bin * w')} AS bin_hi,
  count(*) AS players FROM k GROUP BY feature, churned, bin, lo, w""")


@query("feature_histograms", "A15", _hist_sql())
def q_feature_hist(spark, sf):
    """Six feature distributions, churned vs retained, 30 equal-width bins each."""
    return seg.feature_histograms(frames.latest(spark, sf))


@query("engagement_over_time", "A16", O.with_panel(
    f"SELECT date, {O.r6('avg(sessions_per_week)')} AS avg_sessions, "
    f"{O.r6('avg(avg_session_length_mins)')} AS avg_session_length, {O.r6('avg(monthly_spent)')} AS avg_monthly_spent, "
    f"count(*) AS players FROM panel GROUP BY date"))
def q_engagement_time(spark, sf):
    """Per date: mean sessions, session length and spend over the whole panel."""
    return seg.engagement_over_time(frames.features(spark, sf))


def _profile_cmp_sql() -> str:
    aggs = ", ".join(f"avg(CASE WHEN churned = 0 THEN {m} END) AS r{i}, avg(CASE WHEN churned = 1 THEN {m} END) AS c{i}"
                     for i, m in enumerate(seg.PROFILE_METRICS))
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(r{i} AS DOUBLE) AS retained, CAST(c{i} AS DOUBLE) AS churned "
                              f"FROM wide" for i, m in enumerate(seg.PROFILE_METRICS))
    return O.with_latest(f""", wide AS (SELECT {aggs} FROM latest)
SELECT metric, {O.r6('retained')} AS retained, {O.r6('churned')} AS churned,
  {O.r6(O.rnd('(churned - retained) / nullif(retained, 0) * 100.0', 1))} AS difference_pct FROM ({rows})""")


@query("profile_comparison", "A17", _profile_cmp_sql())
def q_profile_cmp(spark, sf):
    """Mean of six metrics, retained vs churned, with the % difference."""
    return seg.profile_comparison(frames.latest(spark, sf))


@query("dataset_summary", "A18 W8", O.with_panel(f"""
, pp AS (SELECT player_id, count(*) AS rows_, min(date) AS s, max(date) AS e,
                arg_max(churned, date) FILTER (WHERE churned IS NOT NULL) AS ch,
                arg_min(archetype, date) FILTER (WHERE archetype IS NOT NULL) AS ar FROM panel GROUP BY player_id)
SELECT count(*) AS total_players, CAST(sum(rows_) AS BIGINT) AS total_records, min(s) AS start_date, max(e) AS end_date,
  {O.r6('avg(ch)')} AS churn_rate, """ + ", ".join(f"count(*) FILTER (WHERE ar = '{a}') AS n_{a}" for a in ARCHETYPES)
    + " FROM pp"))
def q_dataset_summary(spark, sf):
    """Distinct players, rows, date range, per-player churn rate, first-archetype counts."""
    return seg.dataset_summary(frames.features(spark, sf))


@query("exploration_summary", "A18", O.with_latest(f"""
SELECT count(*) AS total_players, {O.r6('avg(churned)')} AS churn_rate, {O.r6('avg(sessions_per_week)')} AS avg_sessions_per_week,
  {O.r6('avg(monthly_spent)')} AS avg_monthly_spent, count(*) FILTER (WHERE archetype = 'at_risk') AS high_risk_players FROM latest"""))
def q_exploration(spark, sf):
    """The exploration's closing figures: players, churn rate, mean sessions and spend, at-risk players."""
    return seg.exploration_summary(frames.latest(spark, sf))


# ---------------------------------------------------------------- sketches kept by day
_SKETCHED, _RANKS, _PERIOD = ["monthly_spent", "sessions_per_week", "win_rate"], [0.0, 0.25, 0.5, 0.8, 0.95, 1.0], "2024-01-15"


@query("period_quantiles", "A15 L13", O.with_panel(" UNION ALL ".join(
    f"SELECT '{c}' AS metric, CAST({r} AS DOUBLE) AS rank, count({c}) AS n, true AS within_error FROM panel" for c in _SKETCHED for r in _RANKS)))
def q_period_quantiles(spark, sf):
    """Quantiles of three metrics over all days from stored daily KLL sketches, checked against the rows within twice the stated error."""
    panel = materialize(frames.panel(spark, sf))
    stored = materialize(sketches.daily_quantiles(panel, _SKETCHED, ["platform"]))
    found = materialize(sketches.period_quantiles(stored, _RANKS))
    off = sketches.off_by(panel, found, _SKETCHED)
    return off.select("metric", "rank", "n", (F.col("off") <= 2 * sketches.rank_error()).alias("within_error"))


@query("period_players", "A2 A18", O.with_panel(f"""
, a AS (SELECT DISTINCT player_id FROM panel WHERE date < TIMESTAMP '{_PERIOD}'), b AS (SELECT DISTINCT player_id FROM panel WHERE date >= TIMESTAMP '{_PERIOD}')
SELECT (SELECT count(*) FROM a) AS before, (SELECT count(*) FROM b) AS after, (SELECT count(*) FROM a JOIN b USING (player_id)) AS both,
  (SELECT count(*) FROM a ANTI JOIN b USING (player_id)) AS gone, (SELECT count(*) FROM b ANTI JOIN a USING (player_id)) AS new,
  (SELECT count(DISTINCT player_id) FROM panel) AS all_days, true AS hll_within_error"""))
def q_period_players(spark, sf):
    """Distinct players before and after a day, their overlap and all days together, from stored daily sketches."""
    stored = materialize(sketches.daily_players(frames.panel(spark, sf)))
    parts = sketches.overlap(stored.filter(F.col("day") < F.lit(_PERIOD)), stored.filter(F.col("day") >= F.lit(_PERIOD)))
    near = F.abs(F.col("players") - F.col("players_theta")) <= 3 * sketches.distinct_error() * F.col("players_theta")
    whole = sketches.period_players(stored).select(F.struct(F.col("players_theta").alias("all_days"), near.alias("hll_within_error")).alias("w"))
    return parts.select("*", whole.scalar().alias("w")).select("before", "after", "both", "gone", "new", "w.*")
