"""Sinks and loads (S4-S10, S12): tables, upserts, key-value snapshots, metric logs.

Writes go to folders (Parquet by default).  Long jobs cut lineage by writing
each stage to the cluster's shared checkpoint folder and reading it back, so a
lost executor recomputes from the last written stage, not from the raw log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.session import checkpoint_dir

# ---------------------------------------------------------------- S4 / S9 / S10


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> str:
    """Save a table (the folder is created); optional partition columns and in-file sort."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # the default format would cut times to milliseconds
        w = w.options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "player_id",
                   sort: tuple[str, ...] = ("player_id", "date"), dealt: bool = False) -> str:
    """Save a catalog table bucketed by ``key`` and sorted within buckets, its files under ``path``.

    Later reads grouped or joined on ``key`` with the same bucket count skip
    the shuffle; rows are written sorted, so the sort Spark still plans over a
    bucketed scan runs on ordered input.
    """
    # Repartitioning on the bucket key first gives one file per bucket instead of one per (task, bucket).
    # ``dealt``: the caller has done so.
    ((df if dealt else df.repartition(buckets, key)).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(*sort).saveAsTable(table))
    return table


def write_predictions(pred: DataFrame, path: str) -> str:
    """The three-column prediction file."""
    return write_table(pred.select("player_id", "churn_risk_score", "risk_category"), path)


def append_metrics(metrics: DataFrame, path: str) -> str:
    """One JSON line per run, appended."""
    metrics.coalesce(1).write.mode("append").json(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for an intermediate table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/retentia/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared checkpoint folder (lineage cut, executor-loss safe, partitioning kept).

    Spark removes the files with the last reference where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# ---------------------------------------------------------------- S5
def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Insert; on key conflict the update's columns replace the target's, the target's other columns stay.

    Of several updates with one key the last wins: the largest ``order`` value, ties (and updates without an order
    column) by the largest row.  Updates are reduced to one row a key by a partial aggregate; the target is joined
    once, as a full outer join on the keys.  Keys are compared null-safe.  Written by the caller to a fresh path.
    """
    values = [c for c in updates.columns if c not in keys]
    whole = F.struct(*([order] if order else []), *[c for c in values if c != order]) if values else F.struct(F.lit(1).alias("_one"))
    last = updates.groupBy(*keys).agg(F.max(whole).alias("_new"))
    old, new = target.alias("_t"), last.alias("_u")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_t.{k}").eqNullSafe(F.col(f"_u.{k}"))
    joined = old.join(new, same, "full_outer")
    hit = F.col("_u._new").isNotNull()
    cols = [F.when(hit, F.col(f"_u.{k}")).otherwise(F.col(f"_t.{k}")).alias(k) for k in keys]
    for c in [*values, *[c for c in target.columns if c not in keys and c not in values]]:
        mine = F.col(f"_t.{c}") if c in target.columns else F.lit(None)
        cols.append((F.when(hit, F.col(f"_u._new.{c}")).otherwise(mine) if c in values else mine).alias(c))
    return joined.select(*cols)


# ---------------------------------------------------------------- S6
def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One projection casting each declared column to its type; absent → typed null.

    Text that cannot be read as the type becomes null.  A number that does not fit its declared type fails the job
    (ANSI cast): a value is never lost without notice.  Columns the frame has but the schema lacks are kept as text.
    """
    declared = {f.name for f in schema.fields}

    def cast(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType)
        text = isinstance(df.schema[f.name].dataType, T.StringType)
        return F.col(f.name).try_cast(f.dataType) if text else F.col(f.name).cast(f.dataType)

    extra = [F.col(c).cast("string").alias(c) for c in df.columns if c not in declared]
    return df.select(*[cast(f).alias(f.name) for f in schema.fields], *extra)


# ---------------------------------------------------------------- S7 / S8
def iso_timestamp(c) -> "F.Column":
    """ISO 8601 text like Python's ``isoformat()``: microseconds only when they are not zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def feature_kv_snapshot(latest: DataFrame, prefix: str = "player", ttl_days: int = 7,
                        now: str | None = None, key: str = "player_id") -> DataFrame:
    """``prefix:player_id`` → JSON of the latest row (nulls kept, timestamps ISO), with an expiry."""
    ts_now = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    vals = [iso_timestamp(c).alias(c)
            if isinstance(latest.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c)
            for c in latest.columns]
    return latest.select(
        F.concat_ws(":", F.lit(prefix), F.col(key).cast("string")).alias("key"),
        F.to_json(F.struct(*vals), {"ignoreNullFields": "false"}).alias("value"),
        (ts_now + F.expr(f"INTERVAL {int(ttl_days)} DAYS")).alias("expires_at"),
    )


def prediction_kv(pred: DataFrame, ttl_hours: int = 1, now: str | None = None, key: str = "player_id") -> DataFrame:
    """Per-player prediction record with its timestamp and a one-hour expiry."""
    ts_now = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    rec = F.struct(F.col("churn_probability").cast("double").alias("churn_probability"),
                   F.col("risk_category").alias("risk_category"),
                   iso_timestamp(ts_now).alias("timestamp"))
    return pred.select(
        F.concat(F.lit("player:"), F.col(key).cast("string"), F.lit(":prediction")).alias("key"),
        F.to_json(rec).alias("value"),
        (ts_now + F.expr(f"INTERVAL {int(ttl_hours)} HOURS")).alias("expires_at"),
    )


def lookup(kv: DataFrame, keys: DataFrame | list[str], now: str) -> DataFrame:
    """Read back only unexpired entries for the requested keys (semi join, no driver loop)."""
    alive = kv.filter(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    if isinstance(keys, list):
        return alive.filter(F.col("key").isin(keys))
    return alive.join(keys.select("key"), "key", "left_semi")


# ---------------------------------------------------------------- S13 table shapes
def _stable_id(*cols) -> "F.Column":
    """A deterministic id from the row's identity: the whole ``md5(c1 ':' c2 ...)``, reproducible outside Spark.

    128 bits: at 10^12 rows a collision has a chance of about 10^-15.
    """
    return F.md5(F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in cols]))


def to_daily_predictions(scored: DataFrame, model_version: str, prediction_date: str,
                         factors_col: str = "top_risk_factors") -> DataFrame:
    """Rows of the ``daily_predictions`` table (id, player, date, probability, band, version, factors)."""
    from retentia.sources.schemas import DAILY_PREDICTIONS

    d = F.lit(prediction_date).cast("timestamp_ntz")
    out = scored.select(
        _stable_id(F.col("player_id").cast("string"), F.lit(prediction_date), F.lit(model_version))
        .alias("prediction_id"),
        F.col("player_id").cast("string").alias("player_id"), d.alias("prediction_date"),
        F.col("churn_probability").cast("double").alias("churn_probability"), "risk_category",
        F.lit(model_version).alias("model_version"), F.col(factors_col).alias("top_risk_factors"),
    )
    return conform(out, DAILY_PREDICTIONS)


def to_intervention_log(targets: DataFrame, intervention_date: str, cost_per_player: float,
                        status: str = "planned") -> DataFrame:
    """Rows of the ``interventions`` table from tagged targets (K5); results are unknown at planning time."""
    from retentia.sources.schemas import INTERVENTIONS

    d = F.lit(intervention_date).cast("timestamp_ntz")
    out = targets.select(
        _stable_id(F.col("player_id").cast("string"), F.col("intervention"), F.lit(intervention_date))
        .alias("intervention_id"),
        F.col("player_id").cast("string").alias("player_id"), d.alias("intervention_date"),
        F.col("intervention").alias("intervention_type"), F.lit(float(cost_per_player)).alias("intervention_cost"),
        F.lit(status).alias("status"), F.lit(None).cast("string").alias("result"),
        F.col("expected_impact").alias("notes"),
    )
    return conform(out, INTERVENTIONS)


def to_ab_test_record(result: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """One ``ab_tests`` row from ``run_ab_test``: summary columns plus the full result as JSON."""
    from retentia.sources.schemas import AB_TESTS

    out = result.select(
        _stable_id(F.col("test_name"), F.lit(start_date)).alias("test_id"), "test_name",
        F.lit(start_date).cast("timestamp_ntz").alias("start_date"),
        F.lit(end_date).cast("timestamp_ntz").alias("end_date"), "intervention_type",
        F.col("control_size").cast("double").alias("control_size"),
        F.col("treatment_size").cast("double").alias("treatment_size"),
        "control_churn_rate", "treatment_churn_rate", "lift_percentage", "p_value", "is_significant", "status",
        F.to_json(F.struct(*[F.col(c) for c in result.columns])).alias("results"),
    )
    return conform(out, AB_TESTS)


def to_model_monitoring(metrics: DataFrame, run_date: str, notes: str | None = None) -> DataFrame:
    """Rows of the ``model_monitoring`` table from long-form metrics (name, value and, if there, threshold and alert)."""
    from retentia.sources.schemas import MODEL_MONITORING

    have = set(metrics.columns)
    out = metrics.select(
        _stable_id(F.lit(run_date), F.col("metric_name")).alias("monitor_id"),
        F.lit(run_date).cast("timestamp_ntz").alias("monitor_date"), "metric_name",
        F.col("metric_value").cast("double").alias("metric_value"),
        *[(F.col(c) if c in have else F.lit(None)).alias(c) for c in ("threshold_value", "alert_triggered")],
        F.lit(notes).cast("string").alias("notes"))
    return conform(out, MODEL_MONITORING)
