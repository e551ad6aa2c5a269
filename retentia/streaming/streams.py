"""Structured Streaming re-aims (ST1, ST2).

ST1 scores arriving player rows that carry no history (request-time features,
F31) with a model trained on the same columns.

ST2 keeps the newest record per player with a time to live, as a
log-structured table of plain Parquet:

* each micro-batch writes only its own newest-row-per-key as the delta
  partition ``deltas/b=<batch id>`` (cost proportional to the batch, not to the
  state; a replayed batch id overwrites the same partition, so it is idempotent);
* batch numbers go on from what the state holds, also with a new checkpoint;
* every ``compact_every`` batches the deltas are folded into a new base
  snapshot ``base/c=<batch id>``, which counts once ``commits/c=<batch id>``
  is written after it, and the deltas of the base before are removed;
* the current state is ``max_by`` on the event date over the newest base and
  the deltas after it, so a late row never replaces a newer one, and expired
  keys are dropped on read and on compaction.

"Newest wins" is idempotent and order-independent, which is what makes
replays and out-of-order files safe.

The second form of ST2 keeps the same record in Spark's own state store
(RocksDB): one value state a key, timers for the time to live, and the state
itself as a table.
"""

from __future__ import annotations

import contextlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from retentia.functions.columns import round_to
from retentia.operators import model as ml
from retentia.operators.features import serve_features
from retentia.operators.risk import risk_band, risk_factors
from retentia.operators.snapshot import align_features, sanitize
from retentia.sources import files


# ---------------------------------------------------------------- ST1
def score_stream(stream: DataFrame, model: PipelineModel, names: list[str], key: str = "player_id") -> DataFrame:
    """Request-time features → model columns → probability → band and top risk factors, as a streaming plan."""
    feats = risk_factors(serve_features(stream))
    x = sanitize(align_features(feats, names, keep=(key, "date", "top_risk_factors")), names)
    p = ml.probability(model, x, "churn_probability")
    return p.select(key, "date", round_to("churn_probability", 4).alias("churn_probability"),
                    risk_band(round_to("churn_probability", 9)).alias("risk_category"), "top_risk_factors")


def run_score_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model: PipelineModel,
                     names: list[str], sink_dir: str, checkpoint: str, max_files_per_trigger: int | None = None):
    """ST1: file source → score → Parquet sink, processing what is there now (``availableNow``)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_stream(reader.parquet(source_dir), model, names)
    q = (scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- ST2
def newest_per_key(df: DataFrame, key: str = "player_id", order: str = "date") -> DataFrame:
    """The newest whole row per key (``max_by`` of the row struct on the event date)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, "_r.*")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers N of the folders ``x=N`` in ``folder`` (one for each batch kept: bounded by the clean-up)."""
    return sorted(int(n.split("=")[1]) for n in files.names(spark, folder) if "=" in n)


def _latest_base(spark: SparkSession, state_dir: str) -> tuple[DataFrame | None, int]:
    """The newest committed base and its batch number (-1 when there is none).

    A base counts only once its commit marker exists (written after the base), so a compaction interrupted half-way
    is ignored: readers fall back to the previous base plus every later delta.
    """
    committed = _numbers(spark, f"{state_dir}/commits")
    if not committed:
        return None, -1
    return spark.read.parquet(f"{state_dir}/base/c={committed[-1]}"), committed[-1]


def _deltas_after(spark: SparkSession, state_dir: str, after: int) -> DataFrame | None:
    """All batches' rows after batch number ``after``."""
    later = [n for n in _numbers(spark, f"{state_dir}/deltas") if n > after]
    return spark.read.parquet(*[f"{state_dir}/deltas/b={n}" for n in later]) if later else None


def _first_number(spark: SparkSession, state_dir: str, checkpoint: str) -> int:
    """What is added to this query's batch ids, so that they follow whatever the state holds already.

    A new checkpoint counts its batches from 0 again; the offset is fixed when the query first runs with it and kept
    in the checkpoint folder, so that a replayed batch has its old number.
    """
    marker = f"{checkpoint}/state_offset"
    if files.exists(spark, f"{marker}/_SUCCESS"):
        return spark.read.schema("offset long").json(marker).first().offset
    held = _numbers(spark, f"{state_dir}/deltas") + _numbers(spark, f"{state_dir}/commits")
    offset = max(held, default=-1) + 1
    spark.range(1).select(F.lit(offset).cast("long").alias("offset")).coalesce(1).write.mode("overwrite").json(marker)
    return offset


def _expiry_filter(df: DataFrame, ttl_days: int, now: str | None, order: str) -> DataFrame:
    ts_now = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    return df.filter(F.col(order) + F.expr(f"INTERVAL {int(ttl_days)} DAYS") > ts_now)


def current_state(spark: SparkSession, state_dir: str, ttl_days: int, now: str | None,
                  key: str = "player_id", order: str = "date") -> DataFrame:
    """Newest unexpired row per key: the newest base plus every delta written after it."""
    base, base_id = _latest_base(spark, state_dir)
    deltas = _deltas_after(spark, state_dir, base_id)
    parts = [p for p in (base, deltas) if p is not None]
    if not parts:
        raise ValueError(f"no state under {state_dir}")
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(*parts[0].columns))
    return _expiry_filter(newest_per_key(u, key, order), ttl_days, now, order)


def fold_batch(spark: SparkSession, batch: DataFrame, batch_id: int, state_dir: str, ttl_days: int,
               now: str | None, key: str = "player_id", order: str = "date", compact_every: int = 10) -> None:
    """Write one micro-batch's newest rows as a delta; compact into a new base every ``compact_every`` batches."""
    newest_per_key(batch, key, order).write.mode("overwrite").parquet(f"{state_dir}/deltas/b={batch_id}")
    if compact_every and (batch_id + 1) % compact_every == 0:
        state = current_state(spark, state_dir, ttl_days, now, key, order)
        state.write.mode("overwrite").parquet(f"{state_dir}/base/c={batch_id}")
        spark.range(1).select(F.lit(batch_id).alias("batch_id")) \
            .write.mode("overwrite").parquet(f"{state_dir}/commits/c={batch_id}")
        # What the base before this one already covered; its own deltas stay until the next, for readers under way.
        before = max((n for n in _numbers(spark, f"{state_dir}/commits") if n < batch_id), default=-1)
        for n in _numbers(spark, f"{state_dir}/deltas"):
            if n <= before:
                files.remove(spark, f"{state_dir}/deltas/b={n}")


def run_latest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, state_dir: str, checkpoint: str,
                      ttl_days: int = 7, now: str | None = None, max_files_per_trigger: int | None = 1,
                      key: str = "player_id", order: str = "date", compact_every: int = 10) -> DataFrame:
    """ST2: keep the newest record per key from a file stream; returns the current state."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    offset = _first_number(spark, state_dir, checkpoint)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        fold_batch(spark, batch, offset + batch_id, state_dir, ttl_days, now, key, order, compact_every)

    q = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return current_state(spark, state_dir, ttl_days, now, key, order)


# ---------------------------------------------------------------- ST2 on the state store
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE, _EVENT = "newest", "_event"


class NewestRecord(StatefulProcessor):
    """One value state a key, its newest record, which a timer clears when its time to live is over.

    Every newer record is emitted with ``expired`` false, and an expired one once more with ``expired`` true.  Times
    are whole microseconds.  Of records with the same time the first that came stays.
    """

    def __init__(self, key: str, names: list[str], schema: str, order: str, ttl_days: int) -> None:
        self.key, self.names, self.schema, self.order = key, names, schema, order
        self.ttl_ms = ttl_days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(_STATE, self.schema)

    def _due(self, micros: int) -> int:
        return micros // 1000 + self.ttl_ms

    def handleInputRows(self, key, rows, timerValues):
        at = self.names.index(self.order)
        held = self.state.get() if self.state.exists() else None
        best = held
        for r in rows:
            if best is None or r[self.order] > best[at]:
                best = tuple(r[n] for n in self.names)
        if best is held:
            return
        if held is not None:
            self.handle.deleteTimer(self._due(held[at]))
        self.state.update(best)
        self.handle.registerTimer(self._due(best[at]))
        yield Row(**{self.key: key[0]}, **dict(zip(self.names, best)), expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get() if self.state.exists() else None
        if held is not None and self._due(held[self.names.index(self.order)]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield Row(**{self.key: key[0]}, **dict(zip(self.names, held)), expired=True)

    def close(self) -> None:
        pass


def _as_number(f: T.StructField):
    """A time as whole microseconds, which the state keeps without a time zone; other columns as they are."""
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.unix_micros(F.col(f.name).cast("timestamp")).alias(f.name)
    return F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)


def _as_time(f: T.StructField, value):
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.timestamp_micros(value).cast("timestamp_ntz").alias(f.name)
    return F.timestamp_micros(value).alias(f.name) if isinstance(f.dataType, T.TimestampType) else value.alias(f.name)


def newest_stream(stream: DataFrame, key: str = "player_id", order: str = "date", ttl_days: int = 7) -> DataFrame:
    """The changes of each key's newest record as a streaming plan with state (update mode).

    A record older than the newest of all by more than the time to live is expired when it comes; the watermark may
    drop it.  A record without a time cannot be placed and is left out.
    """
    fields = [f for f in stream.schema if f.name != key]
    plain = stream.filter(F.col(order).isNotNull()).select(key, *[_as_number(f) for f in fields], F.col(order).cast("timestamp").alias(_EVENT))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    names = [f.name for f in fields]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    processor = NewestRecord(key, names, schema, order, ttl_days)
    changes = (plain.withWatermark(_EVENT, f"{ttl_days} days").groupBy(key)
               .transformWithState(processor, f"`{key}` {kinds[key]}, {schema}, expired boolean", "Update", "EventTime"))
    return changes.select(key, *[_as_time(f, F.col(f.name)) for f in fields], "expired")


@contextlib.contextmanager
def _on_rocksdb(spark: SparkSession):
    """State in RocksDB, which lies on the executors' disks and in the checkpoint folder, not in their heaps."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


def stored_newest(spark: SparkSession, checkpoint: str, schema: T.StructType, ttl_days: int, now: str | None,
                  key: str = "player_id", order: str = "date") -> DataFrame:
    """The newest unexpired record of each key, read from the state of the query that wrote ``checkpoint``."""
    with _on_rocksdb(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", _STATE).load()
    fields = [_as_time(f, F.col(f"value.{f.name}")) for f in schema if f.name != key]
    rows = state.select(F.col(f"key.{key}").alias(key), *fields).select(*schema.fieldNames())
    return _expiry_filter(rows, ttl_days, now, order)


def run_newest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, checkpoint: str, sink_dir: str | None = None,
                      ttl_days: int = 7, now: str | None = None, max_files_per_trigger: int | None = 1,
                      key: str = "player_id", order: str = "date") -> DataFrame:
    """ST2 with the state in the state store; returns the current state.

    Reads what is there now and goes on from ``checkpoint`` the next time.  The changes go to ``sink_dir`` if given.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = newest_stream(reader.parquet(source_dir), key, order, ttl_days)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if sink_dir is None:
            batch.write.format("noop").mode("overwrite").save()
        else:  # a repeated batch overwrites its own folder
            batch.write.mode("overwrite").parquet(f"{sink_dir}/b={batch_id}")

    with _on_rocksdb(spark):
        q = (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .foreachBatch(on_batch).trigger(availableNow=True).start())
        q.awaitTermination()
    return stored_newest(spark, checkpoint, schema, ttl_days, now, key, order)
