"""Latest-per-player snapshot (W7, W8) and model-input projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import zero_if_not_finite

# Identity / label columns that are never model features.
NON_FEATURE_COLUMNS = (
    "player_id", "date", "registration_date", "archetype",
    "churned", "churn_probability", "country", "platform", "month",
)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def latest_snapshot(df: DataFrame, key: str = "player_id", order: str = "date") -> DataFrame:
    """Per player, the last non-null value of every column by ``order``.

    ``max_by(c, order)`` with the ordering nulled where ``c`` is null skips
    missing values, like pandas ``groupby().last()``.  A grouped aggregate with
    map-side partial aggregation; after the feature windows the input is
    already clustered and sorted on ``key``, so no further exchange is planned.
    """
    aggs = [F.max(order).alias(order)]
    for c in df.columns:
        if c in (key, order):
            continue
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    return df.groupBy(key).agg(*aggs).select(*df.columns)


def first_non_null(c: str, order: str = "date"):
    """Value at the smallest ``order`` among rows where it is present (pandas ``first()``)."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def last_non_null(c: str, order: str = "date"):
    """Value at the largest ``order`` among rows where it is present (pandas ``last()``)."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def first_last(df: DataFrame, first: list[str], last: list[str], key: str = "player_id",
               order: str = "date") -> DataFrame:
    """First value of some columns and last value of others, per player (missing values skipped)."""
    return df.groupBy(key).agg(
        *[first_non_null(c, order).alias(f"first_{c}") for c in first],
        *[last_non_null(c, order).alias(f"last_{c}") for c in last],
    )


def feature_columns(df: DataFrame, exclude=NON_FEATURE_COLUMNS) -> list[str]:
    """Every column but the identity / label ones, in frame order."""
    return [c for c in df.columns if c not in exclude]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (), limit: int | None = None) -> list[str]:
    """P5: numeric columns in order (the dashboard takes the first 15 other than the score)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]
    return cols[:limit] if limit is not None else cols


def sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and +/-inf become 0 in the given columns (one projection)."""
    wanted = set(cols)
    return df.select(*[zero_if_not_finite(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def align_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ("player_id",)) -> DataFrame:
    """Columns in model order; a name the frame lacks becomes 0.0."""
    have = set(df.columns)
    return df.select(
        *[F.col(k) for k in keep if k in have],
        *[(F.col(n) if n in have else F.lit(0.0)).alias(n) for n in names],
    )


def prepare_model_data(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """L1: latest snapshot, feature list, then null / inf → 0 in the features."""
    latest = latest_snapshot(df)
    cols = feature_columns(latest)
    return sanitize(latest, cols), cols
