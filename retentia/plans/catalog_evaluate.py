"""Registered queries: evaluation on given scores (L8, L13-L16) and monitoring (M1-M4)."""

from __future__ import annotations

from retentia.operators import evaluate as ev
from retentia.operators import monitor as mon
from retentia.plans import frames
from retentia.plans import oracle as O
from retentia.plans.catalog_features import D
from retentia.plans.registry import query

S, Y = "churn_risk_score", "churned"


def _metrics_sql(by: str | None, before: str = "", table: str = "scored") -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    join = f"JOIN auc USING ({by})" if by else ", auc"
    return O.with_scored(f"""{before}
, conf AS (SELECT {g}count(*) AS rows,
     count(*) FILTER (WHERE {S} > 0.5 AND {Y} = 1) AS tp, count(*) FILTER (WHERE {S} > 0.5 AND NOT {Y} = 1) AS fp,
     count(*) FILTER (WHERE NOT {S} > 0.5 AND NOT {Y} = 1) AS tn, count(*) FILTER (WHERE NOT {S} > 0.5 AND {Y} = 1) AS fn
   FROM {table} {grp}),
m0 AS (SELECT *, CAST(tp AS DOUBLE) AS dtp, CAST(fp AS DOUBLE) AS dfp, CAST(tn AS DOUBLE) AS dtn,
         CAST(fn AS DOUBLE) AS dfn FROM conf),
m1 AS (SELECT *, coalesce((dtp + dtn) / nullif(dtp + dfp + dtn + dfn, 0), 0.0) AS accuracy,
         coalesce(dtp / nullif(dtp + dfp, 0), 0.0) AS precision, coalesce(dtp / nullif(dtp + dfn, 0), 0.0) AS recall
       FROM m0),
bk AS (SELECT {g}{S} AS bucket, count(*) FILTER (WHERE {Y} = 1) AS pos, count(*) FILTER (WHERE {Y} = 0) AS neg
       FROM {table} GROUP BY {g}{S}),
bk2 AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_below FROM bk),
auc AS (SELECT {g}sum(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) * 0.5))
          / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc FROM bk2 {grp})
SELECT {g}rows, tp, fp, tn, fn, {O.r6('accuracy')} AS accuracy, {O.r6('precision')} AS precision,
  {O.r6('recall')} AS recall,
  {O.r6('CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
  {O.r6('roc_auc')} AS roc_auc
FROM m1 {join}""")


def metrics_select(model: str, score: str, table: str) -> str:
    """L8's figures of the column ``score`` of a table that has ``churned``, as one row with the model's name."""
    return f"""WITH conf AS (SELECT count(*) AS rows,
     CAST(count(*) FILTER (WHERE {score} > 0.5 AND churned = 1) AS BIGINT) AS tp, count(*) FILTER (WHERE {score} > 0.5 AND churned = 0) AS fp,
     count(*) FILTER (WHERE NOT {score} > 0.5 AND churned = 0) AS tn, count(*) FILTER (WHERE NOT {score} > 0.5 AND churned = 1) AS fn FROM {table}),
m AS (SELECT *, CAST(tp + tn AS DOUBLE) / rows AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall FROM conf),
pairs AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END * a.n * b.n) / nullif(sum(a.n * b.n), 0) AS roc_auc
   FROM (SELECT {score} AS s, count(*) AS n FROM {table} WHERE churned = 1 GROUP BY 1) a, (SELECT {score} AS s, count(*) AS n FROM {table} WHERE churned = 0 GROUP BY 1) b)
SELECT '{model}' AS model, rows, tp, fp, tn, fn, {O.r6('accuracy')} AS accuracy, {O.r6('precision')} AS precision, {O.r6('recall')} AS recall,
  {O.r6('CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1, {O.r6('CAST(roc_auc AS DOUBLE)')} AS roc_auc FROM m, pairs"""


@query("model_evaluation", "L8 T10", _metrics_sql(None))
def q_eval(spark, sf):
    """Accuracy, precision, recall, F1, ROC-AUC and confusion counts of the risk score against the label."""
    return ev.evaluate(frames.scored(spark, sf), S, Y)


@query("segment_metrics", "L13", _metrics_sql("platform"))
def q_segment_metrics(spark, sf):
    """The evaluation per platform."""
    return ev.segment_metrics(frames.scored(spark, sf), "platform", score=S, label=Y)


@query("segment_metrics_spenders", "L13", _metrics_sql("spender_tier", """, cut AS (SELECT quantile_disc(monthly_spent, 0.8) AS q FROM scored),
tiers AS (SELECT scored.*, CASE WHEN monthly_spent >= q THEN 'top_20pct' ELSE 'other' END AS spender_tier FROM scored, cut)""", "tiers"))
def q_segment_spenders(spark, sf):
    """The evaluation for the top-20 % spenders (approximate percentile) against the rest."""
    return ev.segment_metrics(ev.with_spender_tier(frames.scored(spark, sf)), "spender_tier", score=S, label=Y)


@query("calibration", "L14", O.with_scored(f"""
, b AS (SELECT CAST(least(floor({S} * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg({S}) AS avg_p,
          avg(CAST({Y} AS DOUBLE)) AS avg_y, sum(({S} - {Y}) * ({S} - {Y})) AS sq FROM scored
        GROUP BY CAST(least(floor({S} * 10), 9) AS INTEGER))
SELECT {O.r6('sum(sq) / nullif(sum(n), 0)')} AS brier,
  {O.r6('sum(n * abs(avg_p - avg_y)) / nullif(sum(n), 0)')} AS ece, CAST(sum(n) AS BIGINT) AS rows FROM b"""))
def q_calibration(spark, sf):
    """Brier score and expected calibration error (10 bins)."""
    return ev.calibration(frames.scored(spark, sf), S, Y)


@query("fairness", "L15", O.with_scored(f"""
, g AS (SELECT platform, avg(CAST({S} > 0.5 AS DOUBLE)) AS positive_rate,
          CAST(count(*) FILTER (WHERE {S} > 0.5 AND {Y} = 1) AS DOUBLE)
            / nullif(CAST(count(*) FILTER (WHERE {Y} = 1) AS DOUBLE), 0) AS tpr FROM scored GROUP BY platform)
SELECT {O.r6('min(positive_rate) / nullif(max(positive_rate), 0)')} AS demographic_parity_ratio,
  {O.r6('min(tpr) / nullif(max(tpr), 0)')} AS equal_opportunity_ratio, count(*) AS groups FROM g"""))
def q_fairness(spark, sf):
    """Positive-rate and true-positive-rate parity across platforms."""
    return ev.fairness(frames.scored(spark, sf), "platform", S, Y)


@query("cost_threshold", "L16", O.with_scored(f"""
, bk AS (SELECT {S} AS bucket, count(*) FILTER (WHERE {Y} = 1) AS pos, count(*) FILTER (WHERE {Y} = 0) AS neg
         FROM scored GROUP BY {S}),
grid AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold FROM range(0, 101) t(k)),
curve AS (SELECT threshold, CAST(coalesce(sum(CASE WHEN bucket < threshold THEN pos ELSE 0 END), 0) AS BIGINT)
            AS false_negatives, CAST(coalesce(sum(CASE WHEN bucket >= threshold THEN neg ELSE 0 END), 0) AS BIGINT)
            AS false_positives FROM bk, grid GROUP BY threshold),
c2 AS (SELECT *, false_negatives * 300.0 + false_positives * 5.0 AS expected_cost FROM curve)
SELECT {O.r6('threshold')} AS threshold, false_negatives, false_positives, {O.r6('expected_cost')} AS expected_cost,
  threshold = (SELECT min(threshold) FROM c2 WHERE expected_cost = (SELECT min(expected_cost) FROM c2)) AS is_best
FROM c2"""))
def q_cost(spark, sf):
    """Expected cost (missed churner 300, wasted offer 5) at 101 thresholds and the cheapest one."""
    return ev.cost_curve(frames.scored(spark, sf), S, Y)


# ---------------------------------------------------------------- M1-M4
RUN_DATE = "2024-02-01"


@query("prediction_distribution", "M1", O.with_scored(f"""
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE risk_category = 'High') AS high_risk,
  count(*) FILTER (WHERE risk_category = 'Medium') AS medium_risk, count(*) FILTER (WHERE risk_category = 'Low') AS low_risk,
  {O.r6(f'avg({S})')} AS avg_churn_probability,
  {O.r6("CAST(count(*) FILTER (WHERE risk_category = 'High') AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100.0")}
    AS high_risk_pct, DATE '{RUN_DATE}' AS run_date FROM scored"""))
def q_pred_dist(spark, sf):
    """Daily prediction summary: counts per band, mean probability, high-risk share."""
    return mon.prediction_distribution(frames.scored(spark, sf), RUN_DATE)


@query("monitoring_alerts", "M2", O.with_scored(f"""
, w AS (SELECT CAST(count(*) FILTER (WHERE risk_category = 'High') AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100.0
          AS high_pct, avg(CAST({Y} AS DOUBLE)) AS actual, avg({S}) AS predicted FROM scored)
SELECT 'high_risk_pct' AS metric_name, {O.r6('high_pct')} AS metric_value, {D(40.0)} AS threshold_value,
  coalesce(high_pct > 40.0, false) AS alert_triggered FROM w
UNION ALL
SELECT 'actual_churn_rate', {O.r6('actual')}, {O.r6('predicted * 1.5')}, coalesce(actual > predicted * 1.5, false) FROM w"""))
def q_alerts(spark, sf):
    """Documented alerts: high-risk share above 40 %, actual churn above 1.5 x predicted."""
    return mon.alerts(frames.scored(spark, sf))


DRIFT_COLS = ["sessions_per_week", "avg_session_length_mins", "days_since_last_login", "monthly_spent",
              "engagement_score", "overall_risk_score"]


def _drift_sql() -> str:
    cur = "date > (SELECT max(date) FROM feat) - INTERVAL 7 DAY"
    aggs = ", ".join(
        f"avg(CASE WHEN {cur} THEN CAST({c} AS DOUBLE) END) AS m{i}, "
        f"avg(CASE WHEN NOT ({cur}) THEN CAST({c} AS DOUBLE) END) AS h{i}, "
        f"stddev_samp(CASE WHEN NOT ({cur}) THEN CAST({c} AS DOUBLE) END) AS s{i}" for i, c in enumerate(DRIFT_COLS))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, m{i} AS mc, h{i} AS mh, s{i} AS sh FROM w"
                              for i, c in enumerate(DRIFT_COLS))
    return O.with_features(f""", w AS (SELECT {aggs} FROM feat)
SELECT feature, {O.r6('mc')} AS mean_current, {O.r6('mh')} AS mean_history, {O.r6('sh')} AS std_history,
  coalesce(abs(mc - mh) > 2.0 * sh, false) AS drift FROM ({rows})""")


@query("feature_drift", "M3", _drift_sql())
def q_drift(spark, sf):
    """Mean shift of six features in the last week against the weeks before, in history standard deviations."""
    return mon.feature_drift(frames.features(spark, sf), DRIFT_COLS, days=7)


QUALITY_RANGES = {"engagement_score": (0.0, 1.0), "overall_risk_score": (0.0, 1.0), "activity_risk": (0.0, 1.0),
                  "engagement_risk": (0.0, 1.0), "monetization_risk": (0.0, 1.0), "win_rate": (0.0, 1.0),
                  "party_play_percentage": (0.0, 1.0), "content_completion_pct": (0.0, 1.0)}
QUALITY_FLAGS = ["is_weekend", "skill_improving", "skill_declining", "low_social_engagement", "solo_player",
                 "has_toxicity_issues", "is_spender", "is_whale", "recent_spender", "content_exhausted", "churned"]


def _quality_sql() -> str:
    checks = [(f"nulls:{c}", f"count(*) FILTER (WHERE {c} IS NULL)") for c in O.ALL_FEATURE_TABLE]
    checks += [(f"out_of_range:{c}", f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi})")
               for c, (lo, hi) in QUALITY_RANGES.items()]
    checks += [(f"not_flag:{c}", f"count(*) FILTER (WHERE NOT {c} IN (0, 1))") for c in QUALITY_FLAGS]
    aggs = ", ".join(f"{e} AS q{i}" for i, (_, e) in enumerate(checks))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", CAST(q{i} AS BIGINT) AS failures FROM w"
                              for i, (n, _) in enumerate(checks))
    return O.with_features(f""", w AS (SELECT {aggs} FROM feat),
d AS (SELECT count(*) AS n FROM feat GROUP BY player_id, date HAVING count(*) > 1)
{rows} UNION ALL SELECT 'duplicate_keys', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM d""")


@query("data_quality", "M4", _quality_sql())
def q_quality(spark, sf):
    """Null counts per column, duplicate (player, date) keys, range and flag checks of the feature table."""
    return mon.data_quality(frames.features(spark, sf), ["player_id", "date"], QUALITY_RANGES, QUALITY_FLAGS)


@query("quality_while_writing", "M4 M5", _quality_sql())
def q_quality_written(spark, sf):
    """The data-quality rows counted by the job that writes the feature table; only its keys are read again."""
    from retentia.plans import jobs

    return jobs.etl_run(spark, sf, checked=QUALITY_RANGES, flags=QUALITY_FLAGS)["quality"]
