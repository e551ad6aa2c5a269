"""Joins (J1-J5) and the dimension lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import score9

PANEL_KEYS = ("player_id", "date")


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a dimension; the planner broadcasts it only where its measured size is under the threshold.

    The static estimate and AQE's runtime statistics are compared with
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a sort-merge join.
    """
    return df.join(dim, on, how)


# ---------------------------------------------------------------- J1
def assemble_panel(*groups: DataFrame, keys=PANEL_KEYS) -> DataFrame:
    """Inner-join attribute groups that share the panel key.

    Each group arrives hash-partitioned on the key by its own aggregate, so the
    sort-merge joins reuse that partitioning: no exchange beyond the groups'.
    """
    if not groups:
        raise ValueError("assemble_panel needs at least one group")
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), groups)


# ---------------------------------------------------------------- J2 / J3 / J4
def join_profile(panel: DataFrame, profiles: DataFrame, key: str = "player_id") -> DataFrame:
    """Inner join of the profile dimension (one row per player).

    Profiles grow with the player count, so no broadcast hint: AQE broadcasts
    at runtime when the measured side is small, sort-merge otherwise.
    """
    return panel.join(profiles, key, "inner")


def join_labels(panel: DataFrame, labels: DataFrame, key: str = "player_id") -> DataFrame:
    return panel.join(labels, key, "left")


def join_predictions(latest: DataFrame, predictions: DataFrame, key: str = "player_id") -> DataFrame:
    """Left join of score and band onto the latest snapshot."""
    return latest.join(predictions.select(key, "churn_risk_score", "risk_category"), key, "left")


# ---------------------------------------------------------------- J5
def fallback_scores(latest: DataFrame, label: str = "churned") -> DataFrame:
    """No predictions: the score is the label and the band comes from right-closed bins.

    With 0/1 labels every retained player (score 0) gets no band, as in the
    dashboard this mirrors.
    """
    from retentia.operators.risk import risk_band_cut

    score = F.col(label).cast("double")
    return latest.withColumn("churn_risk_score", score).withColumn(
        "risk_category", risk_band_cut(score9("churn_risk_score"))
    )
