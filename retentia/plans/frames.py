"""Shared derived frames: panel → features → latest snapshot → scored snapshot.

Each is a lazy DataFrame over the given tables; nothing is collected.  The
scored snapshot uses ``overall_risk_score`` as the churn risk score and the
left-closed band, which is what the dashboard computations consume when no
model has been trained yet (and keeps every downstream query exact).

Every query plans from the raw tables.  With the session conf
``retentia.cache.frames=true`` the engineered feature table and the latest
snapshot are persisted once per application and source (``MEMORY_AND_DISK``:
partitions lost with an executor are recomputed from the lineage) until
``release``; that is for a session of many queries over files that do not
change meanwhile.  A large deployment reads the bucketed table that
``plans.jobs.etl_run`` writes instead.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from retentia.functions.columns import score9
from retentia.operators.features import engineer_all
from retentia.operators.risk import risk_band
from retentia.operators.snapshot import latest_snapshot
from retentia.sources.panel import events_panel, table


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer_all(panel(spark, sf_dir))


def build_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_snapshot(build_features(spark, sf_dir))


_PERSISTED: dict[tuple[str, str, str], DataFrame] = {}


def _cached(spark: SparkSession) -> bool:
    return spark.conf.get("retentia.cache.frames", "false").lower() == "true"


def _shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    if not _cached(spark):
        return build()
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _PERSISTED.get(key)
    if df is None:
        df = build().persist(StorageLevel.MEMORY_AND_DISK)
        _PERSISTED[key] = df
    return df


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engineered panel (F32)."""
    return _shared(spark, sf_dir, "features", lambda: build_features(spark, sf_dir))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every player."""
    if not _cached(spark):
        return build_latest(spark, sf_dir)
    return _shared(spark, sf_dir, "latest", lambda: latest_snapshot(features(spark, sf_dir)))


def release(spark: SparkSession | None = None) -> None:
    """Unpersist the shared snapshots (of one application, or all)."""
    for key in list(_PERSISTED):
        if spark is None or key[0] == spark.sparkContext.applicationId:
            _PERSISTED.pop(key).unpersist()


def with_score(latest_df: DataFrame, score: str = "overall_risk_score") -> DataFrame:
    s = score9(score)
    return latest_df.withColumn("churn_risk_score", s).withColumn("risk_category", risk_band(s))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_score(latest(spark, sf_dir))
