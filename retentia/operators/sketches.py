"""Daily sketches that answer for any period without a rescan (A2, A18 distinct players; A15, L13 quantiles).

A day is scanned once.  Its quantiles are kept as one KLL sketch a metric, its players as one HyperLogLog and one theta
sketch; each is a few kilobytes, whatever the day's rows.  Periods are unions of days: ``merge`` aggregates of the
stored rows.  The exact operators stay the default; what a sketch answers comes with the error that it states:

* KLL: the rank of a returned edge is off by at most ``rank_error(k)`` of the rows, at 99 % confidence; exact while a
  sketch has not more than about k values.
* HyperLogLog and theta: ``distinct_error(lg)`` is the relative standard error; a theta sketch is exact while it holds
  at most 2 ** lg players.  Overlaps of two periods come from theta sketches; their error is that of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches; logarithm of the size of the distinct-count sketches.
K, LG = 400, 14


def rank_error(k: int = K) -> float:
    """Rank error of a KLL quantile at 99 % confidence (the published fit of the sketch's library)."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a count of distinct players by the less exact of the two sketches."""
    return 1.04 / 2 ** (lg / 2)


# ---------------------------------------------------------------- quantiles
def daily_quantiles(panel: DataFrame, metrics: list[str], by: list[str] | None = None, date: str = "date", k: int = K) -> DataFrame:
    """(day, by..., metric, sketch) of each metric's values on each day; nulls and NaN are left out.

    One aggregate over the rows; a day of any size is partially aggregated before the shuffle.
    """
    by = by or []
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = panel.groupBy(F.to_date(date).alias("day"), *by).agg(*[F.kll_sketch_agg_double(number(c), F.lit(k)).alias(f"s{i}") for i, c in enumerate(metrics)])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(metrics)]))
    return wide.select("day", *by, long.alias("m")).select("day", *by, "m.metric", "m.sketch").filter("sketch IS NOT NULL")


def in_period(stored: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored days from ``first`` to ``last``, both included."""
    if first is not None:
        stored = stored.filter(F.col("day") >= F.lit(first).cast("date"))
    return stored if last is None else stored.filter(F.col("day") <= F.lit(last).cast("date"))


def period_quantiles(stored: DataFrame, ranks: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., metric, n, rank, edge): the value at each rank over all stored days given, from merged sketches."""
    merged = stored.groupBy(*(by or []), "metric").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    edges = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias("edge")) for r in ranks]))
    n = F.kll_sketch_get_n_double("sketch")
    return merged.filter(n > 0).select(*(by or []), "metric", n.alias("n"), edges.alias("e")).select(*(by or []), "metric", "n", "e.rank", "e.edge")


def off_by(panel: DataFrame, found: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, rank, edge, off): how far each of ``period_quantiles``' edges is from its rank among the rows themselves.

    One more scan of the rows, to check a sketch; ``off`` is 0 where the rank lies between the shares of rows below the
    edge and at or below it.
    """
    long = panel.select(*[F.col(c).cast("double").alias(c) for c in metrics]).unpivot([], metrics, "metric", "x").filter("x IS NOT NULL AND NOT isnan(x)")
    met = long.join(F.broadcast(found.select("metric", "rank", "edge", "n")), "metric")  # one row a metric and rank
    ranks = met.groupBy("metric", "n", "rank", "edge").agg(F.avg((F.col("x") < F.col("edge")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("edge")).cast("int")).alias("upto"))
    return ranks.select("metric", "n", "rank", "edge", F.greatest(F.lit(0.0), F.col("below") - F.col("rank"), F.col("rank") - F.col("upto")).alias("off"))


#: Quantiles that a histogram is read from; its shares are off by one part in as many, besides the rank error.
STEPS = 1000


def period_histogram(stored: DataFrame, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """A15 from sketches: (by..., metric, bin, bin_lo, bin_hi, share) in equal widths between the least and the largest value.

    ``share`` is the difference of two ranks, each off by the rank error and 1 / ``STEPS`` at most; the two ends are exact.
    """
    by = by or []
    merged = stored.groupBy(*by, "metric").agg(F.kll_merge_agg_double("sketch").alias("sketch")).filter(F.kll_sketch_get_n_double("sketch") > 0)
    ranks = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    read = merged.select(*by, "metric", F.kll_sketch_get_quantile_double("sketch", ranks).alias("q"))
    bounds = read.select("*", F.element_at("q", 1).alias("lo"), F.element_at("q", -1).alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    each = bounds.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    edge = lambda b: F.col("lo") + b * F.col("w")
    below = lambda b: F.size(F.filter("q", lambda v: v < edge(b))) / F.lit(float(STEPS + 1))
    upto = lambda b: F.when(b <= 0, F.lit(0.0)).when(b >= bins, F.lit(1.0)).otherwise(below(b))
    # no width: all rows are in the first bin
    share = F.when(F.col("w") > 0, upto(F.col("bin")) - upto(F.col("bin") - 1)).otherwise(F.when(F.col("bin") == 1, 1.0).otherwise(0.0))
    return each.select(*by, "metric", "bin", edge(F.col("bin") - 1).alias("bin_lo"), edge(F.col("bin")).alias("bin_hi"), share.alias("share"))


def spender_cut(stored: DataFrame, share: float = 0.2, metric: str = "monthly_spent") -> Column:
    """L13's edge of the top spenders over the stored days, as a scalar."""
    return period_quantiles(stored.filter(F.col("metric") == metric), [1.0 - share]).select("edge").scalar()


# ---------------------------------------------------------------- distinct players
def daily_players(panel: DataFrame, by: list[str] | None = None, key: str = "player_id", date: str = "date", lg: int = LG) -> DataFrame:
    """(day, by..., hll, theta): sketches of each day's players."""
    return panel.filter(F.col(key).isNotNull()).groupBy(F.to_date(date).alias("day"), *(by or [])).agg(
        F.hll_sketch_agg(key, F.lit(lg)).alias("hll"), F.theta_sketch_agg(key, F.lit(lg)).alias("theta"))


def period_players(stored: DataFrame, by: list[str] | None = None, lg: int = LG) -> DataFrame:
    """(by..., players, players_theta): distinct players over all stored days given, by either sketch."""
    return stored.groupBy(*(by or [])).agg(
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("players"),
        F.round(F.theta_sketch_estimate(F.theta_union_agg("theta", F.lit(lg)))).cast("long").alias("players_theta"))


def overlap(before: DataFrame, after: DataFrame, lg: int = LG) -> DataFrame:
    """One row (before, after, both, gone, new): players of two periods of stored days, and how they overlap."""
    a = before.agg(F.theta_union_agg("theta", F.lit(lg)).alias("a"))
    b = after.agg(F.theta_union_agg("theta", F.lit(lg)).alias("b"))
    count = lambda c: F.coalesce(F.round(F.theta_sketch_estimate(c)).cast("long"), F.lit(0).cast("long"))
    both = a.select("a", b.select("b").scalar().alias("b"))  # one row each
    return both.select(count(F.col("a")).alias("before"), count(F.col("b")).alias("after"), count(F.theta_intersection("a", "b")).alias("both"),
                       count(F.theta_difference("a", "b")).alias("gone"), count(F.theta_difference("b", "a")).alias("new"))
