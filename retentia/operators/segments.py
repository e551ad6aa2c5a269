"""Filters, top-k and the segment / exploration aggregates (P1-P3, P8, K0a, K0e, A2-A19).

Every aggregate here is a grouped or global aggregate with map-side partial
aggregation; global scalars (totals, minima) are scalar subqueries, never
windows without partition keys, and long-form outputs come from ``unpivot``
of a one-row (or few-row) aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.columns import round_to, safe_div
from retentia.functions.hashing import unit_hash
from retentia.operators.comoments import comoments, correlation
from retentia.operators.risk import spending_segment
from retentia.operators.snapshot import first_non_null, last_non_null
from retentia.sources.panel import ARCHETYPES

SCORE, BAND = "churn_risk_score", "risk_category"


# ---------------------------------------------------------------- P1-P3, P8
def filter_in(df: DataFrame, risk: list[str], platform: list[str] | None = None) -> DataFrame:
    """Band in the list; platform list optional (empty = no platform filter)."""
    out = df.filter(F.col(BAND).isin(list(risk)))
    if platform and "platform" in df.columns:
        out = out.filter(F.col("platform").isin(list(platform)))
    return out


def filter_segment(df: DataFrame, risk: str, spend_segment: str) -> DataFrame:
    """One risk band and one spending segment."""
    return df.filter((F.col(BAND) == risk) & (spending_segment(F.col("monthly_spent")) == spend_segment))


def drop_unlabelled(df: DataFrame, target: str = "churned") -> DataFrame:
    """P3."""
    return df.filter(F.col(target).isNotNull())


def display_projection(df: DataFrame, wanted: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Only the wanted columns that exist, optionally renamed."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in wanted if c in df.columns])


# Columns of the high-risk table.
HIGH_RISK_DISPLAY = ("player_id", "churn_risk_score", "risk_category", "sessions_per_week",
                     "days_since_last_login", "monthly_spent", "friends_online")


# ---------------------------------------------------------------- K0a / K0e
def top_n_risk(df: DataFrame, n: int = 20, score: str = SCORE, key: str = "player_id") -> DataFrame:
    """N rows with the highest score (ties by id): a take-ordered, no global sort."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(n)


def sample_players(df: DataFrame, n: int, seed: int = 42, key: str = "player_id") -> DataFrame:
    """K0e: exact-size repeatable sample: the n smallest md5(seed:id) draws (ties by id).

    A histogram of the draws gives the smallest of 65,536 edges below which n
    rows lie; it is a scalar subquery of one filter, so nothing runs before the
    caller's action.  About n rows plus one bucket pass it, and the ordered
    take merges those, not n rows of every partition.
    """
    parts = 1 << 16
    drawn = df.withColumn("_draw", unit_hash(str(seed), F.col(key)))
    bucket = F.floor(F.col("_draw") * parts)
    counts = drawn.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 rows
    edge = counts.withColumn("upto", upto).filter(F.col("upto") >= n).agg(F.coalesce(F.min("b"), F.lit(parts)))
    return drawn.filter(bucket <= edge.scalar()).orderBy("_draw", key).limit(n).drop("_draw")


# ---------------------------------------------------------------- A2 / A3
def overview_kpis(df: DataFrame) -> DataFrame:
    """A2: players, high-risk count and share, mean score, monthly revenue."""
    n = F.count(F.lit(1))
    high = F.count_if(F.col(BAND) == "High")
    revenue = F.sum("monthly_spent") if "monthly_spent" in df.columns else F.lit(None).cast("double")
    return df.agg(
        n.alias("total_players"), high.alias("high_risk_players"),
        (safe_div(high, n) * F.lit(100.0)).alias("high_risk_pct"),
        F.avg(SCORE).alias("avg_risk_score"), revenue.alias("monthly_revenue"),
    )


def risk_distribution(df: DataFrame) -> DataFrame:
    """A3."""
    return df.groupBy(BAND).agg(F.count(F.lit(1)).alias("players"))


# ---------------------------------------------------------------- A4 / A15 binning
def bin_number(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin in 1..bins; the maximum falls in the last bin; zero width → bin 1."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(x - lo, width)) + F.lit(1)
    return F.when(width > 0, F.least(F.lit(bins).cast("long"), raw)).otherwise(F.lit(1).cast("long"))


def score_histogram(df: DataFrame, bins: int = 50, score: str = SCORE) -> DataFrame:
    """A4: equal-width counts of the score.

    Min and max come from one struct-valued scalar subquery attached once as a
    column (every reference to a scalar Column would otherwise plan its own
    subquery, each re-running the input).
    """
    vals = df.filter(F.col(score).isNotNull())
    bounds = vals.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("b")).select("b").scalar()
    v = vals.select(F.col(score).alias("_x"), bounds.alias("_b"))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    width = (hi - lo) / F.lit(float(bins))
    b = bin_number(F.col("_x"), lo, hi, bins)
    g = v.groupBy(b.alias("bin"), lo.alias("lo"), width.alias("w")).agg(F.count(F.lit(1)).alias("players"))
    return g.select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_hi"), "players")


# ---------------------------------------------------------------- A5
def risk_by(df: DataFrame, dim: str, score: str = SCORE) -> DataFrame:
    """A5: mean score per dimension value, highest first."""
    return df.groupBy(dim).agg(F.avg(score).alias("avg_risk_score"), F.count(F.lit(1)).alias("players")) \
        .orderBy(F.col("avg_risk_score").desc(), F.col(dim))


# ---------------------------------------------------------------- A6 / A7
def _factor_counts(df: DataFrame, factors: list[tuple[str, Column]]) -> DataFrame:
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f{i}")
                                   for i, (_, c) in enumerate(factors)])
    stacked = wide.select(
        "_n", F.explode(F.array(*[F.struct(F.lit(name).alias("factor"), F.col(f"f{i}").alias("players"))
                                  for i, (name, _) in enumerate(factors)])).alias("s"))
    return stacked.select(
        F.col("s.factor").alias("factor"), F.col("s.players").alias("players"),
        F.coalesce(safe_div(F.col("s.players"), F.col("_n")) * F.lit(100.0), F.lit(0.0)).alias("pct"),
    )


def behaviour_risk_counts(df: DataFrame) -> DataFrame:
    """Low activity, inactive > 14 days, declining engagement."""
    decl = F.col("session_decay_rate") > 0.3 if "session_decay_rate" in df.columns else F.lit(False)
    return _factor_counts(df, [
        ("Low Activity", F.col("sessions_per_week") < 2),
        ("Inactive (>14 days)", F.col("days_since_last_login") > 14),
        ("Declining Engagement", decl),
    ])


def social_risk_counts(df: DataFrame) -> DataFrame:
    """Few friends, solo players; zero rows give 0 %."""
    return _factor_counts(df, [
        ("Low Social Connection", F.col("friends_online") < 2 if "friends_online" in df.columns else F.lit(False)),
        ("Solo Player", F.col("party_play_percentage") < 0.2 if "party_play_percentage" in df.columns
         else F.lit(False)),
    ])


# ---------------------------------------------------------------- A8-A10 correlations
def correlation_with(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Correlation of each column with the target, highest first."""
    cols = [c for c in cols if c != target]
    name = F.element_at(F.array(*map(F.lit, [*cols, target])), F.col("i") + 1)
    pairs = comoments(df, [*cols, target], target).filter(F.col("i") < len(cols))
    return pairs.select(name.alias("feature"), correlation().alias("correlation")).orderBy(F.col("correlation").desc_nulls_last(), "feature")


def churn_correlations(df: DataFrame, cols: list[str], target: str = "churned", k: int = 10) -> DataFrame:
    """The k most positive and k most negative correlations with the label."""
    corr = correlation_with(df, target, cols).filter(F.col("correlation").isNotNull())
    key = round_to("correlation", 9)  # ulp-level noise must not reorder exactly tied correlations
    # One row per input column: ranking this tiny frame needs no partition key.
    hi = F.row_number().over(Window.orderBy(key.desc(), F.col("feature")))
    lo = F.row_number().over(Window.orderBy(key.asc(), F.col("feature")))
    ranked = corr.select("feature", "correlation", hi.alias("_hi"), lo.alias("_lo"))
    return ranked.select("feature", "correlation", F.explode(F.array(
        F.when(F.col("_hi") <= k, F.lit("top")), F.when(F.col("_lo") <= k, F.lit("bottom")))).alias("direction")) \
        .filter(F.col("direction").isNotNull())


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: every pair of the given columns (both orders, diagonal included)."""
    name = lambda c: F.element_at(F.array(*map(F.lit, cols)), F.col(c) + 1)
    half = comoments(df, cols).select(name("i").alias("feature_a"), name("j").alias("feature_b"), correlation().alias("correlation"))
    # Both orientations from each pair (the diagonal once), without a union.
    both = F.array(
        F.struct(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), "correlation"),
        F.when(F.col("feature_a") != F.col("feature_b"),
               F.struct(F.col("feature_b").alias("a"), F.col("feature_a").alias("b"), "correlation")))
    return half.select(F.explode(both).alias("o")).filter(F.col("o").isNotNull()).select(
        F.col("o.a").alias("feature_a"), F.col("o.b").alias("feature_b"), F.col("o.correlation").alias("correlation"))


# ---------------------------------------------------------------- A11 / A12
# Spending segment labels in order.
SPEND_SEGMENTS = ("Non-Spender", "Low Spender", "Medium Spender", "High Spender")


def _snake(label: str) -> str:
    return label.lower().replace("-", "_").replace(" ", "_")


def segment_matrix(df: DataFrame) -> DataFrame:
    """Risk band x spending segment counts (pivot over the known labels, zeros filled)."""
    seg = spending_segment(F.col("monthly_spent"))
    out = df.withColumn("spending_segment", seg).groupBy(BAND).pivot("spending_segment", list(SPEND_SEGMENTS)) \
        .agg(F.count(F.lit(1)))
    out = out.select(BAND, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(_snake(s))
                             for s in SPEND_SEGMENTS])
    return out


def segment_profile(df: DataFrame, risk: str, spend_segment: str) -> DataFrame:
    """Size, share of all players and mean activity of one segment."""
    total = df.agg(F.count(F.lit(1))).scalar()
    seg = filter_segment(df, risk, spend_segment)
    n = F.count(F.lit(1))
    return seg.agg(
        n.alias("segment_size"),
        (safe_div(n, total) * F.lit(100.0)).alias("pct_of_total"),
        F.avg("sessions_per_week").alias("avg_sessions"),
        F.avg("avg_session_length_mins").alias("avg_session_length"),
        F.avg("days_since_last_login").alias("avg_days_since_login"),
        F.avg("friends_online").alias("avg_friends_online"),
    ).select(F.lit(risk).alias(BAND), F.lit(spend_segment).alias("spending_segment"), "*")


# ---------------------------------------------------------------- A13 / A14
def churn_by_archetype(latest: DataFrame) -> DataFrame:
    """Churn percent and player count per archetype."""
    return latest.groupBy("archetype").agg(
        (F.avg("churned") * F.lit(100.0)).alias("churn_rate_pct"), F.count(F.lit(1)).alias("players"))


def churn_overview(latest: DataFrame) -> DataFrame:
    """Players, churned, churn rate and archetype counts, in one aggregate."""
    return latest.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.sum("churned").cast("long").alias("churned_players"),
        F.avg("churned").alias("churn_rate"),
        *[F.count_if(F.col("archetype") == a).alias(f"n_{a}") for a in ARCHETYPES],
    )


# ---------------------------------------------------------------- A15
# Features of the distribution plots.
HISTOGRAM_FEATURES = ("sessions_per_week", "avg_session_length_mins", "days_since_last_login",
                      "win_rate", "friends_online", "monthly_spent")


def title_label(c: str) -> Column:
    """A column name as a heading: words for underscores, each with a capital."""
    return F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def feature_histograms(latest: DataFrame, features=HISTOGRAM_FEATURES, label: str = "churned",
                       bins: int = 30, label_values=(0, 1)) -> DataFrame:
    """Per feature and label value, equal-width counts over that subset's range.

    The (feature x label value) bounds come from one global aggregate read as a
    single struct-valued scalar subquery, so the row-level data is neither
    joined nor partitioned by the few (feature, label) keys, which would put
    a large share of all rows into one task.
    """
    aggs = []
    for i, f in enumerate(features):
        for j, v in enumerate(label_values):
            x = F.when(F.col(label) == v, F.col(f).cast("double"))
            aggs += [F.min(x).alias(f"lo_{i}_{j}"), F.max(x).alias(f"hi_{i}_{j}")]
    b = latest.agg(F.struct(*aggs).alias("b")).select("b").scalar()
    lo_e = hi_e = F.lit(None).cast("double")
    for i, f in enumerate(features):
        for j, v in enumerate(label_values):
            hit = (F.col("feature") == f) & (F.col(label) == v)
            lo_e = F.when(hit, F.col(f"_b.lo_{i}_{j}")).otherwise(lo_e)
            hi_e = F.when(hit, F.col(f"_b.hi_{i}_{j}")).otherwise(hi_e)
    long = latest.filter(F.col(label).isin(*label_values)) \
        .select(label, b.alias("_b"), *[F.col(f).cast("double").alias(f) for f in features]) \
        .unpivot([label, "_b"], list(features), "feature", "x").filter(F.col("x").isNotNull())
    j = long.select("feature", label, "x", lo_e.alias("lo"), hi_e.alias("hi"))
    bn = bin_number(F.col("x"), F.col("lo"), F.col("hi"), bins)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return j.groupBy("feature", label, bn.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("players")).select(
        "feature", title_label("feature").alias("title"), label, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "players")


# ---------------------------------------------------------------- A16 / A17
def engagement_over_time(panel: DataFrame) -> DataFrame:
    """Per date, mean sessions, session length and spend over the whole panel."""
    return panel.groupBy("date").agg(
        F.avg("sessions_per_week").alias("avg_sessions"),
        F.avg("avg_session_length_mins").alias("avg_session_length"),
        F.avg("monthly_spent").alias("avg_monthly_spent"),
        F.count(F.lit(1)).alias("players"),
    )


# Metrics of the retained / churned comparison.
PROFILE_METRICS = ("sessions_per_week", "avg_session_length_mins", "days_since_last_login",
                   "friends_online", "monthly_spent", "win_rate")


def profile_comparison(latest: DataFrame, metrics=PROFILE_METRICS, label: str = "churned") -> DataFrame:
    """Mean of each metric for retained vs churned, and the % difference (1 decimal)."""
    aggs = []
    for i, m in enumerate(metrics):
        aggs.append(F.avg(F.when(F.col(label) == 0, F.col(m))).alias(f"r{i}"))
        aggs.append(F.avg(F.when(F.col(label) == 1, F.col(m))).alias(f"c{i}"))
    wide = latest.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"r{i}").alias("retained"), F.col(f"c{i}").alias("churned"))
        for i, m in enumerate(metrics)])).alias("s")).select("s.*")
    return long.withColumn(
        "difference_pct", round_to(F.try_divide(F.col("churned") - F.col("retained"), F.col("retained"))
                                   * F.lit(100.0), 1))


# ---------------------------------------------------------------- A18 / A19
def dataset_summary(panel: DataFrame) -> DataFrame:
    """Distinct players, rows, date range, per-player churn rate, first-archetype counts."""
    per_player = panel.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("date").alias("_start"), F.max("date").alias("_end"),
        last_non_null("churned").alias("_churned"), first_non_null("archetype").alias("_arche"),
    )
    return per_player.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.sum("_rows").alias("total_records"),
        F.min("_start").alias("start_date"),
        F.max("_end").alias("end_date"),
        F.avg("_churned").alias("churn_rate"),
        *[F.count_if(F.col("_arche") == a).alias(f"n_{a}") for a in ARCHETYPES],
    )


def exploration_summary(latest: DataFrame) -> DataFrame:
    """A18 as the exploration saves it: players, churn rate, mean sessions and spend, and at-risk players, of latest rows."""
    return latest.agg(
        F.count(F.lit(1)).alias("total_players"), F.avg("churned").alias("churn_rate"),
        F.avg("sessions_per_week").alias("avg_sessions_per_week"), F.avg("monthly_spent").alias("avg_monthly_spent"),
        F.count_if(F.col("archetype") == "at_risk").alias("high_risk_players"))


def split_churn_rates(split_df: DataFrame, label: str = "churned", split: str = "split") -> DataFrame:
    """Rows and label mean per split."""
    return split_df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("churn_rate"))
