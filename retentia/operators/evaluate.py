"""Evaluation of churn scores against labels.

Rows are first counted per exact score (partial aggregate, one row a score and
task).  Running counts over the scores come in two steps that no single task
has to do alone: a running sum inside each of 10,000 score ranges, and the
ranges' own totals before it.  ROC-AUC is exact, ties counting one half; the
cost curve counts scores on either side of each threshold as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pred(score: str, threshold: float) -> Column:
    return F.col(score) > F.lit(threshold)


def confusion_aggs(score: str, label: str, threshold: float = 0.5) -> list[Column]:
    y, p = F.col(label) == 1, _pred(score, threshold)
    return [
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0),
    }


#: Score ranges over which running counts are spread; a number of tasks, not of digits.
RANGES = 10_000


def score_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per exact score (and segment): rows, positives, negatives and confusion counts, and the score's range."""
    by = by or []
    y, p = F.col(label) == 1, _pred(score, threshold)
    place = F.least(F.greatest(F.floor(F.col("score") * RANGES), F.lit(0)), F.lit(RANGES - 1))
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn")).withColumn("range", F.coalesce(place, F.lit(0)))


def _with_neg_below(counts: DataFrame, by: list[str]) -> DataFrame:
    """Negatives with a lower score: those of the ranges before, and a running sum inside the score's own range."""
    inside = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("range") \
        .rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a segment
    totals = counts.groupBy(*by, "range").agg(F.sum("neg").alias("_neg"))
    offsets = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("range").alias("_range"),
                            F.coalesce(F.sum("_neg").over(ranges), F.lit(0)).alias("_before"))
    same = F.col("range") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (counts.withColumn("_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(offsets, same)
            .withColumn("neg_below", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range", *[f"_{c}" for c in by]))


def _auc(num: Column, p: Column, n: Column) -> Column:
    return F.try_divide(num, p.cast("double") * n.cast("double"))


def evaluate(pred: DataFrame, score: str = "churn_risk_score", label: str = "churned",
             threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """L8 (and L13 with ``by``): accuracy, precision, recall, F1 (0 on zero division), ROC-AUC, confusion.

    One pass over the rows into counts per score, running counts over the
    scores, one final aggregate.
    """
    by = by or []
    b = _with_neg_below(score_counts(pred, score, label, by, threshold), by)
    conf = b.groupBy(*by).agg(
        F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")],
        _auc(F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))), F.sum("pos"), F.sum("neg"))
        .alias("roc_auc"))
    return conf.select(*by, "rows", "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in metric_columns().items()],
                       "roc_auc")


def segment_metrics(pred: DataFrame, dim: str, **kw) -> DataFrame:
    """L8 per segment value."""
    return evaluate(pred, by=[dim], **kw)


def with_spender_tier(df: DataFrame, spend: str = "monthly_spent", q: float = 0.8, out: str = "spender_tier",
                      accuracy: int = 10_000) -> DataFrame:
    """Top-20 % spenders: at or above the approximate 80th percentile (one sketch aggregate, a scalar subquery)."""
    cut = df.agg(F.percentile_approx(spend, q, accuracy)).scalar()
    return df.withColumn("_cut", cut).withColumn(
        out, F.when(F.col(spend) >= F.col("_cut"), "top_20pct").otherwise("other")).drop("_cut")


def calibration(pred: DataFrame, score: str = "churn_risk_score", label: str = "churned", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over ``bins`` equal-width probability bins."""
    p = F.col(score).cast("double")
    b = F.least(F.floor(p * F.lit(bins)), F.lit(bins - 1)).cast("int")
    per_bin = pred.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("avg_p"), F.avg(F.col(label).cast("double")).alias("avg_y"),
        F.sum((p - F.col(label)) * (p - F.col(label))).alias("sq"))
    return per_bin.agg(
        F.try_divide(F.sum("sq"), F.sum("n")).alias("brier"),
        F.try_divide(F.sum(F.col("n") * F.abs(F.col("avg_p") - F.col("avg_y"))), F.sum("n")).alias("ece"),
        F.sum("n").alias("rows"),
    )


def fairness(pred: DataFrame, dim: str, score: str = "churn_risk_score", label: str = "churned",
             threshold: float = 0.5) -> DataFrame:
    """min/max ratio across groups of the positive rate and of the true-positive rate."""
    p, y = _pred(score, threshold), F.col(label) == 1
    g = pred.groupBy(dim).agg(
        F.avg(p.cast("double")).alias("positive_rate"),
        F.try_divide(F.count_if(p & y).cast("double"), F.count_if(y).cast("double")).alias("tpr"),
    )
    return g.agg(
        F.try_divide(F.min("positive_rate"), F.max("positive_rate")).alias("demographic_parity_ratio"),
        F.try_divide(F.min("tpr"), F.max("tpr")).alias("equal_opportunity_ratio"),
        F.count(F.lit(1)).alias("groups"),
    )


def cost_curve(pred: DataFrame, score: str = "churn_risk_score", label: str = "churned", fn_cost: float = 300.0,
               fp_cost: float = 5.0, steps: int = 100) -> DataFrame:
    """Expected cost at thresholds 0, 1/steps, ..., 1 (positive when score >= t) and the best one.

    A row's place among the thresholds is the number of them that its score
    reaches (compared as they are, not rounded); rows are counted by place, and
    the thresholds are joined to these steps + 2 rows at most.  The cheapest
    threshold is the lowest on ties.
    """
    value = F.col(score).cast("double")
    guess = F.least(F.greatest(F.floor(value * steps), F.lit(0)), F.lit(steps))
    at = lambda k: k / F.lit(float(steps))
    place = (F.when(value < 0, 0).when(at(guess) > value, guess)  # rounding may put the guess one off, either way
             .when((guess < steps) & (at(guess + 1) <= value), guess + 2).otherwise(guess + 1))
    counts = pred.filter(value.isNotNull()).groupBy(place.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    x = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    above = F.col("reached") > F.col("k")
    curve = x.groupBy("k").agg(
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("false_negatives"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("false_positives"),
    ).select(at(F.col("k")).alias("threshold"), "false_negatives", "false_positives",
             (F.col("false_negatives") * F.lit(fn_cost) + F.col("false_positives") * F.lit(fp_cost)).alias("expected_cost"))
    rank = F.row_number().over(Window.orderBy("expected_cost", "threshold"))  # steps + 1 rows
    return curve.withColumn("is_best", rank == 1)
