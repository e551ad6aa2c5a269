"""Batch jobs.

The panel and the feature windows share one partitioning, so the log becomes
features in one plan; the feature table is the first thing written, and all
that follows reads it back: losing an executor late in the job recomputes from
there, not from the log.
"""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.columns import score9
from retentia.operators import model as ml
from retentia.operators import monitor
from retentia.operators.features import engineer_all
from retentia.operators.risk import merge_states, risk_band, risk_band_cut, summary_of_states, summary_state
from retentia.operators.snapshot import latest_snapshot
from retentia.sources.buckets import BucketedTable, upsert_buckets
from retentia.sources.panel import events_panel, scan_panel, table
from retentia.sources.sinks import (append_metrics, feature_kv_snapshot, materialize, stage_path, write_bucketed,
                                    write_predictions, write_table)


def bucket_count(df: DataFrame, bytes_per_bucket: int = 256 << 20, most: int = 20_000) -> int:
    """Buckets for what is made from ``df``: by its size as the planner knows it, at least as many as shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_bucket)))


def etl_run(spark: SparkSession, sf_dir: str, out_dir: str | None = None, ttl_days: int = 7,
            now: str | None = None, bucketed: bool = False, buckets: int | None = None, table_name: str | None = None,
            checked: dict[str, tuple[float, float]] | None = None, flags: list[str] = ()) -> dict:
    """M5: extract (events → panel) → transform (F32) → load (feature table + key-value snapshot).

    If ``bucketed``, the feature table is saved as a catalog table bucketed by
    ``player_id`` and sorted by (player_id, date), so per-player reads
    (snapshots, windows, joins) need no shuffle; the number of buckets follows
    the input's size unless it is given.  Otherwise plain Parquet sorted within
    files.  With ``checked`` (allowed ranges by column; ``flags`` are 0 or 1) the result holds
    M4's rows as ``quality``, counted while the table is written; only its keys are read again.
    """
    t0 = time.time()
    out_dir = out_dir or stage_path(spark, "etl")
    events = table(spark, sf_dir, "events")
    panel = events_panel(events, table(spark, sf_dir, "nation"))
    features_path = f"{out_dir}/player_features"
    whole, quality = engineer_all(panel), None
    if bucketed:
        buckets = buckets or bucket_count(events)
        whole = whole.repartition(buckets, "player_id")
    if checked:  # behind the last shuffle, by the tasks that write
        whole, quality = monitor.observe_quality(whole, checked, flags)
    if bucketed:
        table_name = table_name or "player_features"
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        write_bucketed(whole, table_name, features_path, buckets, dealt=True)
        features = spark.table(table_name)
    else:
        write_table(whole, features_path, sort_within=["player_id", "date"])
        features = spark.read.parquet(features_path)
    kv_path = write_table(feature_kv_snapshot(latest_snapshot(features), ttl_days=ttl_days, now=now),
                          f"{out_dir}/feature_cache")
    rows = quality and quality().unionByName(monitor.duplicate_keys(features, ["player_id", "date"]))
    return {"features_path": features_path, "features_table": table_name if bucketed else None, "kv_path": kv_path, "quality": rows,
            "duration_sec": round(time.time() - t0, 3)}


def etl_load(spark: SparkSession, features: DataFrame, path: str, batch: str | None = None, buckets: int = 64,
             keys: tuple[str, ...] = ("player_id", "date")) -> dict:
    """M5's load into a table that stays: ``features`` are upserted by (player, date), bucket by bucket.

    The folder becomes a table of ``buckets`` buckets by player with the first batch.  ``batch`` names the run; a run
    that is repeated under its name changes nothing.  Only the buckets of players that ``features`` hold are rewritten.
    """
    t0 = time.time()
    target = _table_at(spark, path, [keys[0]], buckets)
    given = materialize(features)
    touched = upsert_buckets(target, given, list(keys), batch=batch)
    return {"features_path": path, "buckets": touched, "duration_sec": round(time.time() - t0, 3)}


def refresh_summary(spark: SparkSession, path: str, batch: DataFrame, name: str | None = None, buckets: int = 64) -> DataFrame:
    """A1 kept up from new rows alone: the batch's states are merged into the stored ones; the whole view.

    The batch's rows may be of any date, but each feature row comes once (``name`` guards a repeated batch).  The plan
    scans the batch and the stored states of the batch's buckets.
    """
    stored = _table_at(spark, path, ["player_id"], buckets)
    stored.merge(materialize(summary_state(batch)), merge_states, name)
    return summary_of_states(stored.rows())


def _table_at(spark: SparkSession, path: str, by: list[str], buckets: int) -> BucketedTable:
    try:
        return BucketedTable.open(spark, path)
    except ValueError:
        return BucketedTable.create(spark, path, by, buckets)


def score_frame(latest: DataFrame, model: PipelineModel | None, names: list[str] | None) -> DataFrame:
    """Scores for the daily job: model probability when a model is given, else the rule-based risk score."""
    if model is not None:
        from retentia.operators.snapshot import align_features, sanitize

        x = sanitize(align_features(latest, names), names)
        p = ml.probability(model, x, "churn_risk_score")
    else:
        p = latest.select("player_id", F.col("overall_risk_score").alias("churn_risk_score"))
    s = score9("churn_risk_score")
    return p.select("player_id", F.col("churn_risk_score"), risk_band_cut(s).alias("risk_category"),
                    risk_band(s).alias("risk_category_left_closed"))


def daily_run(spark: SparkSession, sf_dir: str, model: PipelineModel | None = None, names: list[str] | None = None,
              out_dir: str | None = None, run_date: str | None = None) -> DataFrame:
    """M6: ingest → features → load → score → monitor, one written stage after another.

    Bands use the right-closed bins of the daily job (K1b); the monitoring row
    is gathered while the predictions are written and appended as one JSON line per run.
    """
    out_dir = out_dir or stage_path(spark, "daily")
    panel = events_panel(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))
    feats = spark.read.parquet(write_table(engineer_all(panel), f"{out_dir}/player_features"))
    latest = materialize(latest_snapshot(feats))
    preds, distribution = monitor.observe_predictions(score_frame(latest, model, names), run_date)
    write_predictions(preds, f"{out_dir}/predictions")
    append_metrics(distribution(), f"{out_dir}/monitoring")
    return spark.read.json(f"{out_dir}/monitoring")


def batch_score_file(spark: SparkSession, path: str, model: PipelineModel, names: list[str],
                     out_path: str | None = None) -> DataFrame:
    """Score a stored panel file (S1) with the whole feature pipeline and write the predictions."""
    feats = engineer_all(scan_panel(spark, path))
    scored = ml.score_latest(feats, model, names)
    out_path = out_path or stage_path(spark, "batch-scores")
    write_table(scored, out_path)
    return spark.read.parquet(out_path)
