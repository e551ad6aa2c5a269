"""Risk bands, risk factors, segments, interventions and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import flag, round_to, score9

# ---------------------------------------------------------------- K1
LOW_EDGE, HIGH_EDGE = 0.3, 0.7


def risk_band(score: Column) -> Column:
    """K1a, left-closed: < 0.3 Low, < 0.7 Medium, else High (null stays null)."""
    return (F.when(score < LOW_EDGE, "Low").when(score < HIGH_EDGE, "Medium")
            .when(score.isNotNull(), "High"))


def risk_band_cut(score: Column) -> Column:
    """K1b, right-closed bins (0, 0.3], (0.3, 0.7], (0.7, 1]; 0 and out-of-range give null."""
    return (F.when((score > 0) & (score <= LOW_EDGE), "Low")
            .when((score > LOW_EDGE) & (score <= HIGH_EDGE), "Medium")
            .when((score > HIGH_EDGE) & (score <= 1.0), "High"))


# ---------------------------------------------------------------- K2
# Rule-based risk factors (name, impact, column, test), highest impact first.
RISK_FACTOR_RULES = (
    ("Low Session Frequency", 0.3, "sessions_per_week", lambda c: c < 2),
    ("Inactive Player", 0.25, "days_since_last_login", lambda c: c > 14),
    ("Declining Engagement", 0.2, "session_decay_rate", lambda c: c > 0.3),
    ("Low Social Connection", 0.15, "friends_online", lambda c: c < 2),
    ("No Recent Purchases", 0.1, "days_since_last_purchase", lambda c: c > 90),
)
MAX_FACTORS = 5


def risk_factors(df: DataFrame, out: str = "top_risk_factors") -> DataFrame:
    """K2: array<struct<factor, impact, value>> of the rules that fire, by impact, at most 5."""
    items = [
        F.when(F.coalesce(test(F.col(c)), F.lit(False)),
               F.struct(F.lit(name).alias("factor"), F.lit(impact).alias("impact"),
                        F.col(c).cast("double").alias("value")))
        for name, impact, c, test in RISK_FACTOR_RULES
    ]
    fired = F.filter(F.array(*items), lambda x: x.isNotNull())
    return df.withColumn(out, F.slice(fired, 1, MAX_FACTORS))


def risk_factor_rows(df: DataFrame, key: str = "player_id") -> DataFrame:
    """K2 in long form: one row per (player, factor) with its rank."""
    return risk_factors(df).select(key, F.posexplode("top_risk_factors").alias("pos", "f")).select(
        key, (F.col("pos") + 1).alias("factor_rank"), F.col("f.factor").alias("factor"),
        F.col("f.impact").alias("impact"), F.col("f.value").alias("value"),
    )


# ---------------------------------------------------------------- K3 / K4
def spending_segment(spend: Column) -> Column:
    """K3, right-closed bins (-0.1, 0], (0, 10], (10, 50], (50, inf]."""
    return (F.when((spend > -0.1) & (spend <= 0), "Non-Spender")
            .when((spend > 0) & (spend <= 10), "Low Spender")
            .when((spend > 10) & (spend <= 50), "Medium Spender")
            .when(spend > 50, "High Spender"))


def ltv(spend: Column, months: float = 12) -> Column:
    """K4: lifetime value = monthly spend x retention months."""
    return spend * F.lit(months)


# ---------------------------------------------------------------- K5
# Intervention campaigns (name, expected impact, test on the latest row).
INTERVENTIONS = (
    ("Re-engagement Campaign", "12-15% churn reduction", lambda: F.col("sessions_per_week") < 2),
    ("Social Connection Nudge", "8-10% churn reduction", lambda: F.col("friends_online") < 2),
    ("First Purchase Incentive", "15-20% churn reduction", lambda: F.col("monthly_spent") == 0),
    ("New Content Preview", "10-12% churn reduction", lambda: F.col("content_completion_pct") > 0.8),
)


def intervention_targets(latest: DataFrame, band_col: str = "risk_category", band: str = "High",
                         key: str = "player_id") -> DataFrame:
    """K5: High-band players tagged with every campaign they qualify for (not exclusive)."""
    tags = [F.when(F.coalesce(test(), F.lit(False)), F.struct(F.lit(n).alias("intervention"),
                                                              F.lit(i).alias("expected_impact")))
            for n, i, test in INTERVENTIONS]
    return (latest.filter(F.col(band_col) == band)
            .select(key, F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("t"))
            .select(key, "t.intervention", "t.expected_impact"))


def intervention_counts(latest: DataFrame, **kw) -> DataFrame:
    return (intervention_targets(latest, **kw).groupBy("intervention", "expected_impact")
            .agg(F.count(F.lit(1)).alias("players")))


# ---------------------------------------------------------------- K6 / K0b
def priority_scores(latest: DataFrame, score: str = "churn_risk_score", band_col: str = "risk_category",
                    band: str = "High", months: float = 12) -> DataFrame:
    """K6: 0.5 score + 0.3 ltv / max(ltv) + 0.2 engagement, High band only.

    The maximum is a scalar subquery (one aggregate job, its single value
    inlined), so no join and no window without partition keys.
    """
    high = latest.filter(F.col(band_col) == band).withColumn("ltv", ltv(F.col("monthly_spent"), months))
    max_ltv = high.agg(F.max("ltv")).scalar()
    eng = F.col("engagement_score") if "engagement_score" in latest.columns else F.lit(0.0)
    return high.withColumn(
        "priority_score",
        F.col(score) * F.lit(0.5) + F.try_divide(F.col("ltv"), max_ltv) * F.lit(0.3) + eng * F.lit(0.2),
    )


def priority_queue(latest: DataFrame, n: int = 20, key: str = "player_id", **kw) -> DataFrame:
    """The n highest priority scores (take-ordered; ties by player id)."""
    cols = [key, kw.get("score", "churn_risk_score"), "ltv", "priority_score", "sessions_per_week",
            "days_since_last_login"]
    return (priority_scores(latest, **kw).select(*cols)
            .orderBy(F.col("priority_score").desc_nulls_last(), F.col(key)).limit(n))


# ---------------------------------------------------------------- K7 / K8
def roi_columns(targeted: Column, cost: Column, lift: Column, spend: Column, months: Column) -> dict[str, Column]:
    player_ltv = spend * months
    saved = targeted * lift
    revenue = saved * player_ltv
    total_cost = targeted * cost
    net = revenue - total_cost
    return {
        "player_ltv": player_ltv,
        "players_saved": saved,
        "revenue_retained": revenue,
        "total_cost": total_cost,
        "net_benefit": net,
        "roi_pct": F.when(total_cost > 0, net / total_cost * F.lit(100.0)).otherwise(F.lit(0.0)),
        "breakeven_players": F.try_divide(total_cost, player_ltv),
    }


def roi_projection(latest: DataFrame, segment: str = "risk_category", cost: float = 5.0, lift: float = 0.15,
                   months: float = 12) -> DataFrame:
    """K7 per segment: targeted players and mean spend come from the snapshot."""
    agg = latest.groupBy(segment).agg(
        F.count(F.lit(1)).alias("players_targeted"), F.avg("monthly_spent").alias("avg_monthly_spend"))
    cols = roi_columns(F.col("players_targeted"), F.lit(float(cost)), F.lit(float(lift)),
                       F.col("avg_monthly_spend"), F.lit(float(months)))
    return agg.select(segment, "players_targeted", "avg_monthly_spend", *[c.alias(n) for n, c in cols.items()])


# Sensitivity grid of the ROI page.
SENSITIVITY_LIFTS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
SENSITIVITY_COSTS = (1.0, 2.0, 5.0, 10.0, 15.0, 20.0)


def roi_sensitivity(latest: DataFrame, segment: str = "risk_category", months: float = 12,
                    lifts=SENSITIVITY_LIFTS, costs=SENSITIVITY_COSTS) -> DataFrame:
    """K8: ROI % over the lift x cost grid, per segment, in long form.

    The grid is a literal array exploded next to each segment's aggregate row:
    the fan-out is bounded by the grid size and needs no join.
    """
    grid = F.array(*[F.struct(F.lit(float(c)).alias("cost"), F.lit(float(l)).alias("lift"))
                     for c in costs for l in lifts])
    agg = latest.groupBy(segment).agg(
        F.count(F.lit(1)).alias("players_targeted"), F.avg("monthly_spent").alias("avg_monthly_spend"))
    g = agg.select(segment, "players_targeted", "avg_monthly_spend", F.explode(grid).alias("g"))
    cols = roi_columns(F.col("players_targeted"), F.col("g.cost"), F.col("g.lift"), F.col("avg_monthly_spend"),
                       F.lit(float(months)))
    return g.select(segment, F.col("g.cost").alias("cost_per_player"), F.col("g.lift").alias("lift"),
                    cols["roi_pct"].alias("roi_pct"))


# ---------------------------------------------------------------- K9
def rule_churn_probability(latest: DataFrame, out: str = "churn_probability") -> DataFrame:
    """K9: rule-based churn probability on the latest row, clipped to [0, 1], 4 decimals."""
    p = F.lit(0.0)
    p = p + F.when(flag(F.col("sessions_per_week") < 1) == 1, 0.3).otherwise(0.0)
    p = p + F.when(flag(F.col("days_since_last_login") > 14) == 1, 0.3).otherwise(0.0)
    p = p + F.when(flag(F.col("session_decay_rate") > 0.5) == 1, 0.2).otherwise(0.0)
    p = p + F.when(flag(F.col("friends_online") < 2) == 1, 0.1).otherwise(0.0)
    p = p + F.when(flag(F.col("days_since_last_purchase") > 90) == 1, 0.1).otherwise(0.0)
    arche = F.col("archetype")
    p = p + F.when(arche == "at_risk", 0.4).when(arche == "hardcore", -0.3).otherwise(0.0)
    return latest.withColumn(out, round_to(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), 4))


# ---------------------------------------------------------------- A1
def risk_summary(features: DataFrame) -> DataFrame:
    """A1: the per-player risk summary view, from all rows (``refresh_summary`` keeps it up from new rows alone)."""
    return features.groupBy("player_id").agg(
        F.max("date").alias("last_update"),
        F.max("overall_risk_score").alias("risk_score"),
        F.avg("sessions_per_week").alias("avg_sessions"),
        F.avg("monthly_spent").alias("avg_spent"),
        F.max("total_spent").alias("total_spent"),
        F.max("friends_online").alias("friends_count"),
        F.max("platform").alias("platform"),
        F.max("archetype").alias("archetype"),
    ).withColumn("risk_category", risk_band(score9("risk_score")))


#: The state of a player's summary, column by column: how a batch's value comes about and how two values merge.
_SUMMARY_STATE = (
    ("last_update", lambda: F.max("date"), "max"), ("risk_score", lambda: F.max("overall_risk_score"), "max"),
    ("sessions_sum", lambda: F.sum("sessions_per_week"), "sum"), ("sessions_count", lambda: F.count("sessions_per_week"), "sum"),
    ("spent_sum", lambda: F.sum("monthly_spent"), "sum"), ("spent_count", lambda: F.count("monthly_spent"), "sum"),
    ("total_spent", lambda: F.max("total_spent"), "max"), ("friends_count", lambda: F.max("friends_online"), "max"),
    ("platform", lambda: F.max("platform"), "max"), ("archetype", lambda: F.max("archetype"), "max"),
)


def summary_state(features: DataFrame, key: str = "player_id") -> DataFrame:
    """One row a player that keeps what A1 needs of these rows: maxima, sums and counts, which merge in any order."""
    return features.groupBy(key).agg(*[make().alias(name) for name, make, _ in _SUMMARY_STATE])


def merge_states(a: DataFrame, b: DataFrame, key: str = "player_id") -> DataFrame:
    """The states of the rows of both: one partial aggregate over the two, whatever their order."""
    merged = [(F.max if how == "max" else F.sum)(name).alias(name) for name, _, how in _SUMMARY_STATE]
    return a.unionByName(b).groupBy(key).agg(*merged)


def summary_of_states(states: DataFrame, key: str = "player_id") -> DataFrame:
    """A1 from the stored states: the same rows as ``risk_summary`` over everything that went into them."""
    return states.select(
        key, "last_update", "risk_score",
        F.try_divide("sessions_sum", "sessions_count").alias("avg_sessions"), F.try_divide("spent_sum", "spent_count").alias("avg_spent"),
        "total_spent", "friends_count", "platform", "archetype", risk_band(score9("risk_score")).alias("risk_category"))
