"""Registered queries: A/B experiments (B1-B10) on the scored latest snapshot."""

from __future__ import annotations

from retentia.functions.stats import z_quantile
from retentia.operators import experiment as ab
from retentia.plans import frames
from retentia.plans import oracle as O
from retentia.plans.catalog_features import D
from retentia.plans.registry import query

TEST, INTERVENTION, EFFECT, CONTROL, PERIOD, ALPHA = "retention_test", "discount_offer", 0.15, 0.5, 30, 0.05
COST, LTV = 5.0, 300.0
GROUP = ab.group_col(TEST)


def _input(spark, sf):
    return ab.prepare_ab_input(frames.scored(spark, sf))


def _outcomes(spark, sf):
    return ab.expected_effect(ab.assign_groups(_input(spark, sf), TEST, CONTROL), TEST, INTERVENTION, EFFECT)


# Fixed value: what the discount offer leaves of the churn probability (stated here, not taken from the code).
DISCOUNT_LEAVES = 0.85


# ---------------------------------------------------------------- SQL twin chain
_AB_CTE = f"""
, ab0 AS (SELECT player_id, churned, churn_risk_score AS churn_probability,
            CASE WHEN {O.unit_hash(f"'{TEST}'", 'player_id')} < {D(CONTROL)} THEN 'control' ELSE 'treatment' END AS {GROUP}
          FROM scored),
ab2 AS (SELECT *, CASE WHEN {GROUP} = 'treatment' THEN churn_probability * {D(DISCOUNT_LEAVES)} ELSE churn_probability END
            AS expected_churn_prob FROM ab0),
cnt AS (SELECT count(*) FILTER (WHERE {GROUP} = 'control') AS control_n,
               count(*) FILTER (WHERE {GROUP} = 'control' AND churned = 1) AS control_churned,
               count(*) FILTER (WHERE {GROUP} = 'treatment') AS treatment_n,
               count(*) FILTER (WHERE {GROUP} = 'treatment' AND churned = 1) AS treatment_churned
        FROM ab2),
c0 AS (SELECT *, CAST(control_n AS DOUBLE) AS cn, CAST(treatment_n AS DOUBLE) AS tn,
              CAST(control_churned AS DOUBLE) AS cch, CAST(treatment_churned AS DOUBLE) AS tch FROM cnt),
ret AS (SELECT *, cch / nullif(cn, 0) AS control_churn_rate, tch / nullif(tn, 0) AS treatment_churn_rate FROM c0),
ret2 AS (SELECT *, 1.0 - control_churn_rate AS control_retention, 1.0 - treatment_churn_rate AS treatment_retention
         FROM ret),
ret3 AS (SELECT *, treatment_retention - control_retention AS absolute_lift,
           CASE WHEN control_retention > 0 THEN treatment_retention / control_retention - 1.0 ELSE 0.0 END AS relative_lift
         FROM ret2),
chi0 AS (SELECT *, cn - cch AS a, cch AS b, tn - tch AS c, tch AS d FROM ret3),
chi1 AS (SELECT *, a + b + c + d AS n, a + b AS r1, c + d AS r2, a + c AS k1, b + d AS k2 FROM chi0),
chi2 AS (SELECT *, r1 * k1 / n AS ea, r1 * k2 / n AS eb, r2 * k1 / n AS ec, r2 * k2 / n AS ed,
           (r1 > 0 AND r2 > 0 AND k1 > 0 AND k2 > 0) AS full_table FROM chi1),
chi3 AS (SELECT *, greatest(abs(a - ea) - 0.5, 0.0) AS va, greatest(abs(b - eb) - 0.5, 0.0) AS vb,
           greatest(abs(c - ec) - 0.5, 0.0) AS vc, greatest(abs(d - ed) - 0.5, 0.0) AS vd FROM chi2),
chi4 AS (SELECT *, CASE WHEN full_table THEN va * va / ea + vb * vb / eb + vc * vc / ec + vd * vd / ed ELSE 0.0 END
           AS chi2_statistic FROM chi3),
chi5 AS (SELECT *, CASE WHEN full_table THEN {O.erfc_nonneg('sqrt(greatest(chi2_statistic, 0.0) / 2.0)')}
                        ELSE 1.0 END AS chi2_p_value,
           CASE WHEN full_table THEN 1 ELSE 0 END AS chi2_dof FROM chi4),
z0 AS (SELECT *, cn - cch AS cs, tn - tch AS ts FROM chi5),
z1 AS (SELECT *, (cs + ts) / nullif(cn + tn, 0) AS pooled, cs / nullif(cn, 0) AS pc, ts / nullif(tn, 0) AS pt FROM z0),
z2 AS (SELECT *, sqrt(pooled * (1.0 - pooled) * (1.0 / nullif(cn, 0) + 1.0 / nullif(tn, 0))) AS se FROM z1),
z3 AS (SELECT *, CASE WHEN se > 0 THEN (pt - pc) / se ELSE 0.0 END AS z_score FROM z2),
z4 AS (SELECT *, {O.erfc_nonneg(f'abs(z_score) / {2.0 ** 0.5!r}')} AS z_p_value,
         (pt - pc) - 1.96 * se AS ci95_lower, (pt - pc) + 1.96 * se AS ci95_upper FROM z3),
res AS (SELECT *, z_p_value < {D(ALPHA)} AS significant,
          CASE WHEN z_p_value < {D(ALPHA)} THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS conclusion FROM z4)"""


def ab_sql(select: str) -> str:
    return O.with_scored(_AB_CTE + "\n" + select)


@query("ab_assign_groups", "B1 B10", ab_sql(f"SELECT player_id, {GROUP} FROM ab0"))
def q_assign(spark, sf):
    """Hash-based control / treatment split (50 %) of every scored player."""
    return ab.assign_groups(_input(spark, sf), TEST, CONTROL).select("player_id", GROUP)


@query("ab_expected_effect", "B2", ab_sql(
    f"SELECT player_id, {GROUP}, {O.r6('expected_churn_prob')} AS expected_churn_prob FROM ab2"))
def q_effect(spark, sf):
    """Churn probability that is expected under the discount offer."""
    return _outcomes(spark, sf).select("player_id", GROUP, "expected_churn_prob")


@query("ab_retention_metrics", "B3", ab_sql(f"""
SELECT '{TEST}' AS test_name, {PERIOD} AS retention_period_days, control_n AS control_size, treatment_n AS treatment_size,
  {O.r6('control_retention')} AS control_retention, {O.r6('control_churn_rate')} AS control_churn_rate,
  {O.r6('treatment_retention')} AS treatment_retention, {O.r6('treatment_churn_rate')} AS treatment_churn_rate,
  {O.r6('absolute_lift')} AS absolute_lift, {O.r6('relative_lift')} AS relative_lift,
  {O.r6('relative_lift * 100.0')} AS relative_lift_pct FROM res"""))
def q_retention(spark, sf):
    """Group sizes, retention, churn and lifts."""
    return ab.retention_metrics(_outcomes(spark, sf), TEST, retention_period_days=PERIOD)


@query("ab_statistical_test", "B4 B5 B6", ab_sql(f"""
SELECT {O.r6('chi2_statistic')} AS chi2_statistic, {O.r6('chi2_p_value')} AS chi2_p_value, chi2_dof,
  {O.r6('z_score')} AS z_score, {O.r6('z_p_value')} AS z_p_value, significant, conclusion,
  {O.r6('ci95_lower')} AS ci95_lower, {O.r6('ci95_upper')} AS ci95_upper, {D(ALPHA)} AS alpha FROM res"""))
def q_stats(spark, sf):
    """Chi-square (Yates), pooled two-proportion z-test and the 95 % interval of the lift."""
    return ab.statistical_test(_outcomes(spark, sf), TEST, alpha=ALPHA)


MDES = (0.02, 0.05, 0.10)


def _sample_size_sql() -> str:
    k = (z_quantile(1 - ALPHA / 2) + z_quantile(0.8)) ** 2
    grid = " UNION ALL ".join(f"SELECT {D(m)} AS mde" for m in MDES)
    return O.with_latest(f"""
, base AS (SELECT archetype, avg(churned) AS baseline_rate, count(*) AS players FROM latest GROUP BY archetype)
SELECT archetype, {O.r6('baseline_rate')} AS baseline_rate, players, mde,
  CAST(ceil({k!r} * (baseline_rate * (1.0 - baseline_rate) + (baseline_rate + mde) * (1.0 - (baseline_rate + mde)))
       / (mde * mde)) AS BIGINT) AS required_per_group
FROM base, ({grid}) g""")


@query("ab_sample_size", "B7", _sample_size_sql())
def q_sample_size(spark, sf):
    """Players needed per group, per archetype baseline churn rate and minimum detectable effect."""
    return ab.sample_size_by(frames.latest(spark, sf), "archetype", MDES)


_RESULT_COLS = f"""'{TEST}' AS test_name, '{INTERVENTION}' AS intervention_type, {D(EFFECT)} AS expected_effect_size,
  {D(CONTROL)} AS control_share, {PERIOD} AS retention_period_days, control_n AS control_size,
  treatment_n AS treatment_size, {O.r6('control_churn_rate')} AS control_churn_rate,
  {O.r6('treatment_churn_rate')} AS treatment_churn_rate, {O.r6('control_retention')} AS control_retention,
  {O.r6('treatment_retention')} AS treatment_retention, {O.r6('absolute_lift')} AS absolute_lift,
  {O.r6('relative_lift * 100.0')} AS lift_percentage, {O.r6('chi2_statistic')} AS chi2_statistic,
  {O.r6('chi2_p_value')} AS chi2_p_value, chi2_dof, {O.r6('z_score')} AS z_score, {O.r6('z_p_value')} AS p_value,
  significant AS is_significant, conclusion, {O.r6('ci95_lower')} AS ci95_lower, {O.r6('ci95_upper')} AS ci95_upper,
  'completed' AS status"""


@query("ab_test_result", "B8", ab_sql(f"SELECT {_RESULT_COLS} FROM res"))
def q_result(spark, sf):
    """The whole experiment as one result row."""
    return ab.run_ab_test(_input(spark, sf), TEST, INTERVENTION, EFFECT, CONTROL, PERIOD, ALPHA)


@query("ab_roi", "B9", ab_sql(f"""
, roi AS (SELECT treatment_n, treatment_n * absolute_lift AS saved, treatment_n * absolute_lift * {D(LTV)} AS revenue,
            treatment_n * {D(COST)} AS cost FROM res)
SELECT '{TEST}' AS test_name, {D(COST)} AS intervention_cost, {D(LTV)} AS player_ltv,
  treatment_n AS treatment_group_size, {O.r6('saved')} AS players_saved, {O.r6('revenue')} AS revenue_retained,
  {O.r6('cost')} AS total_cost, {O.r6('revenue - cost')} AS net_benefit,
  {O.r6('CASE WHEN cost > 0 THEN (revenue - cost) / cost * 100.0 ELSE 0.0 END')} AS roi_percentage,
  {O.r6('CASE WHEN saved > 0 THEN cost / saved ELSE 0.0 END')} AS cost_per_retained_player FROM roi"""))
def q_ab_roi(spark, sf):
    """Return on the tested intervention (cost 5 per player, lifetime value 300)."""
    return ab.ab_roi(ab.run_ab_test(_input(spark, sf), TEST, INTERVENTION, EFFECT, CONTROL, PERIOD, ALPHA), COST, LTV)


@query("ab_prepare_sample", "B10 K0e", O.with_scored(f"""
SELECT player_id, {O.r6('churn_risk_score')} AS churn_probability FROM scored
ORDER BY {O.unit_hash("'42'", 'player_id')}, player_id LIMIT 10000"""))
def q_prepare(spark, sf):
    """Experiment input: an exact-size repeatable sample of 10,000 players (the page's default) with a probability."""
    return ab.prepare_ab_input(frames.scored(spark, sf), n=10_000).select("player_id", "churn_probability")
