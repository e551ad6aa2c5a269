"""The newest record of each key in the state store: late rows, restart, expiry, against the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.streaming import streams

SCHEMA = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("date", T.TimestampNTZType()), T.StructField("seen", T.TimestampType()),
                       T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
DAY0 = datetime(2024, 1, 1)


def rows(seed, n, days, players=12):
    rng = random.Random(seed)
    return [(rng.randrange(players), DAY0 + timedelta(days=rng.choice(days), microseconds=seed * 10_000 + k), DAY0 + timedelta(hours=k),
             rng.choice([None, rng.random()]), rng.choice([None, "ä", "b"])) for k in range(n)]


def land(spark, path, data):
    """One file, in one piece, so that it is one micro-batch."""
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def expected(data, now, ttl):
    newest = {}
    for r in data:
        if r[1] is not None and (r[0] not in newest or r[1] > newest[r[0]][1]):
            newest[r[0]] = r
    return sorted((r for r in newest.values() if r[1] + timedelta(days=ttl) > now), key=repr)


def got(df):
    return sorted(((r.player_id, r.date, r.seen.replace(tzinfo=None), r.x, r.s) for r in df.withColumn("seen", F.col("seen").cast("timestamp_ntz")).collect()), key=repr)


@pytest.fixture
def run(spark, tmp_path):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")

    def step(data, now, ttl=14, sink=None):
        land(spark, src, data)
        return streams.run_newest_stream(spark, src, SCHEMA, cp, sink, ttl_days=ttl, now=now.isoformat(sep=" "), max_files_per_trigger=1)
    return step


def test_late_rows_and_restarts(run):
    parts = [rows(1, 40, [5, 9, 12]), rows(2, 40, [1, 2, 9]), rows(3, 20, [0, 13, 20]), [(99, None, DAY0, 1.0, "x"), (3, DAY0 + timedelta(days=19), DAY0, 2.0, None)]]
    now, so_far = DAY0 + timedelta(days=21), []
    for part in parts:  # each a run of its own that goes on from the checkpoint
        so_far += part
        assert got(run(part, now)) == expected(so_far, now, 14)


def test_timers_clear_what_is_over(run, spark, tmp_path):
    sink = str(tmp_path / "changes")
    old, new = rows(1, 30, [1, 2]), rows(2, 30, [60], players=6)
    now = DAY0 + timedelta(days=61)
    run(old, now, ttl=7, sink=sink)
    assert got(run(new, now, ttl=7, sink=sink)) == expected(old + new, now, 7)
    run(rows(3, 5, [61], players=2), now, ttl=7, sink=sink)  # one more batch, whose watermark passes the timers
    with streams._on_rocksdb(spark):
        kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "newest").load()
    assert {r.key.player_id for r in kept.collect()} == {r[0] for r in new} | {r[0] for r in rows(3, 5, [61], players=2)}
    changes = spark.read.option("recursiveFileLookup", True).parquet(sink)
    gone = {r.player_id for r in changes.filter("expired").collect()}
    assert gone == {r[0] for r in old} - {r[0] for r in new}


def test_of_equal_times_the_first_stays(run):
    at = DAY0 + timedelta(days=3)
    first = run([(1, at, DAY0, 1.0, "first")], at)
    assert got(first) == [(1, at, DAY0, 1.0, "first")]
    assert got(run([(1, at, DAY0, 2.0, "second")], at)) == [(1, at, DAY0, 1.0, "first")]


def test_the_provider_setting_is_given_back(run, spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(rows(1, 3, [1]), DAY0)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == was
