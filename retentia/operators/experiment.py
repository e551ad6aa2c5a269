"""A/B experiment operators.

Group assignment is a hash of ``(test, player_id)``, not ``rand()``: the split
is reproducible, independent of partitioning, and a recomputed task after an
executor loss draws the same values.  Outcomes are observed columns.  All test
statistics come from one global aggregate (four counts), then column
arithmetic on that single row: no data reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.hashing import unit_hash
from retentia.functions.stats import chi2_sf_dof1, two_sided_p, z_quantile
from retentia.operators.segments import sample_players

# Churn multipliers of the named interventions.
INTERVENTION_MULTIPLIERS = {
    "discount_offer": 0.85,
    "engagement_campaign": 0.90,
    "social_nudge": 0.92,
    "content_unlock": 0.88,
    "personalized_message": 0.93,
}
DEFAULT_BASE_CHURN = 0.25


def group_col(test: str) -> str:
    return f"{test}_group"


# ---------------------------------------------------------------- B1
def assign_groups(df: DataFrame, test: str, control_size: float = 0.5, key: str = "player_id") -> DataFrame:
    """Adds ``{test}_group`` = control / treatment, control with probability ``control_size``."""
    u = unit_hash(test, F.col(key))
    return df.withColumn(group_col(test), F.when(u < F.lit(float(control_size)), "control").otherwise("treatment"))


# ---------------------------------------------------------------- B2
def base_churn(df: DataFrame) -> Column:
    if "churn_probability" in df.columns:
        return F.col("churn_probability").cast("double")
    if "churned" in df.columns:
        return F.col("churned").cast("double")
    return F.lit(DEFAULT_BASE_CHURN)


def expected_effect(df: DataFrame, test: str, intervention: str, effect_size: float = 0.15) -> DataFrame:
    """``expected_churn_prob``: in the treatment group the base probability times the intervention's multiplier.

    An intervention without a multiplier of its own has 1 - ``effect_size``.  What came of the test is observed,
    not drawn: the statistics below take a column of outcomes.
    """
    g = group_col(test)
    if g not in df.columns:
        raise ValueError(f"assign_groups has not been run for test {test!r}: column {g!r} is missing")
    m = INTERVENTION_MULTIPLIERS.get(intervention, 1.0 - effect_size)
    return df.withColumn("expected_churn_prob",
                         F.when(F.col(g) == "treatment", base_churn(df) * F.lit(m)).otherwise(base_churn(df)))


def prepare_ab_input(df: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """Optional exact-size sample, then ``churn_probability`` = itself, else the score, else 0.25."""
    if n is not None:
        df = sample_players(df, n, seed)
    if "churn_probability" in df.columns:
        return df
    if "churn_risk_score" in df.columns:
        return df.withColumn("churn_probability", F.col("churn_risk_score"))
    return df.withColumn("churn_probability", F.lit(DEFAULT_BASE_CHURN))


# ---------------------------------------------------------------- B3-B6 on one aggregate row
def outcome_counts(df: DataFrame, test: str, outcome: str = "churned") -> DataFrame:
    """One row: sizes and churned counts of both groups."""
    g, y = F.col(group_col(test)), F.col(outcome)
    return df.agg(
        F.count_if(g == "control").alias("control_n"),
        F.count_if((g == "control") & (y == 1)).alias("control_churned"),
        F.count_if(g == "treatment").alias("treatment_n"),
        F.count_if((g == "treatment") & (y == 1)).alias("treatment_churned"),
        F.count_if(y == 0).alias("_retained_any"),
        F.count_if(y == 1).alias("_churned_any"),
    )


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def retention_columns() -> dict[str, Column]:
    """B3 on the counts row."""
    cc = F.try_divide(_d("control_churned"), _d("control_n"))
    tc = F.try_divide(_d("treatment_churned"), _d("treatment_n"))
    cr, tr = F.lit(1.0) - cc, F.lit(1.0) - tc
    rel = F.when(cr > 0, tr / cr - F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "control_retention": cr, "control_churn_rate": cc,
        "treatment_retention": tr, "treatment_churn_rate": tc,
        "absolute_lift": tr - cr, "relative_lift": rel, "relative_lift_pct": rel * F.lit(100.0),
    }


def chi_square_columns() -> dict[str, Column]:
    """2x2 chi-square with Yates' correction (each |O-E| shrunk by at most 0.5).

    A table with one group or one outcome value only has no degree of
    freedom: statistic 0, p-value 1.
    """
    a, b = _d("control_n") - _d("control_churned"), _d("control_churned")
    c, d = _d("treatment_n") - _d("treatment_churned"), _d("treatment_churned")
    n = a + b + c + d
    r1, r2, k1, k2 = a + b, c + d, a + c, b + d

    def term(o, row, col):
        e = row * col / n
        v = F.greatest(F.abs(o - e) - F.lit(0.5), F.lit(0.0))
        return v * v / e

    full = (r1 > 0) & (r2 > 0) & (k1 > 0) & (k2 > 0)
    stat = F.when(full, term(a, r1, k1) + term(b, r1, k2) + term(c, r2, k1) + term(d, r2, k2)).otherwise(F.lit(0.0))
    return {
        "chi2_statistic": stat,
        "chi2_p_value": F.when(full, chi2_sf_dof1(stat)).otherwise(F.lit(1.0)),
        "chi2_dof": F.when(full, F.lit(1)).otherwise(F.lit(0)),
    }


def z_test_columns(alpha: float = 0.05) -> dict[str, Column]:
    """Pooled two-proportion z-test on retained counts and the 95 % interval of the lift."""
    cs, ts = _d("control_n") - _d("control_churned"), _d("treatment_n") - _d("treatment_churned")
    cn, tn = _d("control_n"), _d("treatment_n")
    pooled = F.try_divide(cs + ts, cn + tn)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), cn) + F.try_divide(F.lit(1.0), tn)))
    pc, pt = F.try_divide(cs, cn), F.try_divide(ts, tn)
    z = F.when(se > 0, (pt - pc) / se).otherwise(F.lit(0.0))
    p = two_sided_p(z)
    half = F.lit(1.96) * se
    return {
        "z_score": z, "z_p_value": p, "significant": p < F.lit(alpha),
        "conclusion": F.when(p < F.lit(alpha), "SIGNIFICANT").otherwise("NOT SIGNIFICANT"),
        "ci95_lower": (pt - pc) - half, "ci95_upper": (pt - pc) + half,
    }


def retention_metrics(df: DataFrame, test: str, outcome: str = "churned",
                      retention_period_days: int = 30) -> DataFrame:
    """B3 as a one-row frame."""
    counts = outcome_counts(df, test, outcome)
    return counts.select(F.lit(test).alias("test_name"), F.lit(retention_period_days).alias("retention_period_days"),
                         F.col("control_n").alias("control_size"), F.col("treatment_n").alias("treatment_size"),
                         *[c.alias(n) for n, c in retention_columns().items()])


def statistical_test(df: DataFrame, test: str, outcome: str = "churned", alpha: float = 0.05) -> DataFrame:
    """B4-B6 as a one-row frame."""
    counts = outcome_counts(df, test, outcome)
    return counts.select(*[c.alias(n) for n, c in {**chi_square_columns(), **z_test_columns(alpha)}.items()],
                         F.lit(alpha).alias("alpha"))


# ---------------------------------------------------------------- B7
def sample_size(baseline: Column, mde: float | Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Required players per group: ceil((z_a + z_b)^2 (p1 q1 + p2 q2) / mde^2), z from the driver; null for no effect."""
    za, zb = z_quantile(1 - alpha / 2), z_quantile(power)
    m = F.lit(float(mde)) if isinstance(mde, (int, float)) else mde
    p1, p2 = baseline, baseline + m
    n = F.lit((za + zb) ** 2) * (p1 * (F.lit(1.0) - p1) + p2 * (F.lit(1.0) - p2))
    return F.ceil(F.try_divide(n, m * m))


def sample_size_by(df: DataFrame, segment: str, mdes=(0.02, 0.05, 0.10), label: str = "churned",
                   alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """B7 per segment: the baseline churn rate comes from the data; one row per (segment, mde)."""
    base = df.groupBy(segment).agg(F.avg(label).alias("baseline_rate"), F.count(F.lit(1)).alias("players"))
    rows = base.select(segment, "baseline_rate", "players",
                       F.explode(F.array(*[F.lit(float(m)) for m in mdes])).alias("mde"))
    return rows.withColumn("required_per_group", sample_size(F.col("baseline_rate"), F.col("mde"), alpha, power))


# ---------------------------------------------------------------- B8 / B9
def run_ab_test(df: DataFrame, test: str, intervention: str, effect_size: float = 0.15, control_size: float = 0.5,
                retention_period: int = 30, alpha: float = 0.05, key: str = "player_id", outcome: str = "churned") -> DataFrame:
    """Assign → count the observed ``outcome`` → one result row (``ab_tests``-shaped plus statistics).

    Groups that are there already (``{test}_group``) are kept, as in a test that has run.
    """
    out = df if group_col(test) in df.columns else assign_groups(df, test, control_size, key)
    counts = outcome_counts(out, test, outcome)
    r, chi, z = retention_columns(), chi_square_columns(), z_test_columns(alpha)
    return counts.select(
        F.lit(test).alias("test_name"), F.lit(intervention).alias("intervention_type"),
        F.lit(float(effect_size)).alias("expected_effect_size"), F.lit(float(control_size)).alias("control_share"),
        F.lit(retention_period).alias("retention_period_days"),
        F.col("control_n").alias("control_size"), F.col("treatment_n").alias("treatment_size"),
        r["control_churn_rate"].alias("control_churn_rate"), r["treatment_churn_rate"].alias("treatment_churn_rate"),
        r["control_retention"].alias("control_retention"), r["treatment_retention"].alias("treatment_retention"),
        r["absolute_lift"].alias("absolute_lift"), r["relative_lift_pct"].alias("lift_percentage"),
        chi["chi2_statistic"].alias("chi2_statistic"), chi["chi2_p_value"].alias("chi2_p_value"),
        chi["chi2_dof"].alias("chi2_dof"), z["z_score"].alias("z_score"), z["z_p_value"].alias("p_value"),
        z["significant"].alias("is_significant"), z["conclusion"].alias("conclusion"),
        z["ci95_lower"].alias("ci95_lower"), z["ci95_upper"].alias("ci95_upper"),
        F.lit("completed").alias("status"),
    )


def ab_roi(result: DataFrame, intervention_cost: float, player_ltv: float) -> DataFrame:
    """B9 on a ``run_ab_test`` row: players saved, revenue, cost, net, ROI %, cost per saved player."""
    saved = F.col("treatment_size") * F.col("absolute_lift")
    revenue = saved * F.lit(float(player_ltv))
    cost = F.col("treatment_size") * F.lit(float(intervention_cost))
    net = revenue - cost
    return result.select(
        "test_name", F.lit(float(intervention_cost)).alias("intervention_cost"),
        F.lit(float(player_ltv)).alias("player_ltv"), F.col("treatment_size").alias("treatment_group_size"),
        saved.alias("players_saved"), revenue.alias("revenue_retained"), cost.alias("total_cost"),
        net.alias("net_benefit"),
        F.when(cost > 0, net / cost * F.lit(100.0)).otherwise(F.lit(0.0)).alias("roi_percentage"),
        F.when(saved > 0, cost / saved).otherwise(F.lit(0.0)).alias("cost_per_retained_player"),
    )
