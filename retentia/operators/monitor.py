"""Monitoring (M1-M4): prediction distribution, alerts, feature drift, data quality.

Each monitor is one aggregate pass; long-form rows follow the
``model_monitoring`` table (metric_name, metric_value, threshold_value,
alert_triggered).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from retentia.functions.columns import safe_div

SCORE, BAND = "churn_risk_score", "risk_category"

# Documented alert thresholds.
HIGH_RISK_ALERT_PCT = 40.0
ACTUAL_OVER_PREDICTED = 1.5
DRIFT_STDS = 2.0


def prediction_distribution(pred: DataFrame, run_date: str | None = None) -> DataFrame:
    """M1: total, count per band, mean score, high-risk percent (and the run date)."""
    return pred.agg(*_prediction_figures()).withColumn("run_date", _date(run_date))


def _date(run_date: str | None) -> Column:
    return F.lit(run_date).cast("date") if run_date else F.current_date()


def _prediction_figures() -> list[Column]:
    n = F.count(F.lit(1))
    high = F.count_if(F.col(BAND) == "High")
    return [
        n.alias("total_predictions"), high.alias("high_risk"),
        F.count_if(F.col(BAND) == "Medium").alias("medium_risk"), F.count_if(F.col(BAND) == "Low").alias("low_risk"),
        F.avg(SCORE).alias("avg_churn_probability"), (safe_div(high, n) * F.lit(100.0)).alias("high_risk_pct")]


def observe_predictions(pred: DataFrame, run_date: str | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """M1 while writing: ``pred``, to be written as it is, and a function that gives M1's row once it has been.

    The figures are gathered by the job that writes, without a second scan.  Write the frame straight away: a task that
    is repeated before a shuffle would count its rows twice, one of the last stage does not.
    """
    seen = Observation()
    frame = pred.observe(seen, *_prediction_figures())

    def row() -> DataFrame:
        return _one_row(pred, seen, pred.agg(*_prediction_figures()).schema).withColumn("run_date", _date(run_date))
    return frame, row


def _one_row(df: DataFrame, seen: Observation, schema) -> DataFrame:
    got = seen.get  # waits for the job that writes
    return df.sparkSession.createDataFrame([tuple(got[c] for c in schema.fieldNames())], schema)


def _long(rows: list[tuple[str, Column, Column, Column]]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric_name"), v.cast("double").alias("metric_value"),
                 t.cast("double").alias("threshold_value"), a.alias("alert_triggered"))
        for name, v, t, a in rows]))


def alerts(pred: DataFrame, label: str = "churned") -> DataFrame:
    """M2: high-risk share above 40 %; actual churn above 1.5 x the predicted rate."""
    n = F.count(F.lit(1))
    wide = pred.agg((safe_div(F.count_if(F.col(BAND) == "High"), n) * F.lit(100.0)).alias("high_pct"),
                    F.avg(F.col(label).cast("double")).alias("actual"), F.avg(SCORE).alias("predicted"))
    limit = F.col("predicted") * F.lit(ACTUAL_OVER_PREDICTED)
    rows = [
        ("high_risk_pct", F.col("high_pct"), F.lit(HIGH_RISK_ALERT_PCT),
         F.coalesce(F.col("high_pct") > HIGH_RISK_ALERT_PCT, F.lit(False))),
        ("actual_churn_rate", F.col("actual"), limit, F.coalesce(F.col("actual") > limit, F.lit(False))),
    ]
    return wide.select(_long(rows).alias("m")).select("m.*")


def feature_drift(df: DataFrame, cols: list[str], days: int = 7, order: str = "date") -> DataFrame:
    """M3: |mean of the last ``days`` days - mean before| > 2 x std before, per feature.

    The cutoff is a scalar subquery (one column of the input); means and the
    sample deviation are Spark's merged moments, which stay exact for values
    far from zero, in one aggregate without a window.
    """
    newest = df.agg(F.max(order)).scalar()
    recent = F.col(order) > newest - F.expr(f"INTERVAL {int(days)} DAYS")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        old = F.when(~recent, x)
        aggs += [F.avg(F.when(recent, x)).alias(f"m{i}"), F.avg(old).alias(f"h{i}"), F.stddev_samp(old).alias(f"d{i}")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean_current"), F.col(f"h{i}").alias("mean_history"),
                 F.col(f"d{i}").alias("std_history")) for i, c in enumerate(cols)])).alias("s")).select("s.*")
    gap = F.abs(F.col("mean_current") - F.col("mean_history"))
    return long.withColumn("drift", F.coalesce(gap > F.lit(DRIFT_STDS) * F.col("std_history"), F.lit(False)))


def data_quality(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]],
                 flags: list[str] = ()) -> DataFrame:
    """M4: null counts, duplicate keys, out-of-range values and non-0/1 flags, in long form.

    Rows beyond the first of a key count as duplicates (a null equals a null):
    an ordinary grouped count, whatever the number of key columns, beside the
    one aggregate of all other checks.
    """
    checks = _checks(df.columns, ranges, flags)
    wide = df.agg(*[v.alias(f"q{i}") for i, (_, v) in enumerate(checks)])
    return _check_rows(wide, checks).unionByName(duplicate_keys(df, keys))


def _checks(columns: list[str], ranges: dict[str, tuple[float, float]], flags) -> list[tuple[str, Column]]:
    checks: list[tuple[str, Column]] = [(f"nulls:{c}", F.count_if(F.col(c).isNull())) for c in columns]
    checks += [(f"out_of_range:{c}", F.count_if((F.col(c) < lo) | (F.col(c) > hi))) for c, (lo, hi) in ranges.items()]
    return checks + [(f"not_flag:{c}", F.count_if(~F.col(c).isin(0, 1))) for c in flags]


def _check_rows(wide: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"q{i}").cast("long").alias("failures"))
        for i, (name, _) in enumerate(checks)])).alias("s")).select("s.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """M4's row of duplicate keys; it reads the key columns only."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("more")).agg(
        F.lit("duplicate_keys").alias("check"), F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("failures"))


def observe_quality(df: DataFrame, ranges: dict[str, tuple[float, float]], flags: list[str] = ()) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """M4 while writing: ``df``, to be written as it is, and a function that gives M4's rows once it has been.

    All checks but the duplicate keys, which need a grouping (``duplicate_keys``, on what was written).  As with
    ``observe_predictions``, write the frame straight away.
    """
    checks, seen = _checks(df.columns, ranges, flags), Observation()
    figures = [v.alias(f"q{i}") for i, (_, v) in enumerate(checks)]
    frame = df.observe(seen, *figures)
    return frame, lambda: _check_rows(_one_row(df, seen, df.agg(*figures).schema), checks)
