"""Tables in buckets: upserts that rewrite touched buckets only, recovery, and the summary kept up from batches."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from retentia.operators import risk
from retentia.plans import jobs
from retentia.sources import sinks
from retentia.sources.buckets import BucketedTable, upsert_buckets

SCHEMA = "player_id long, date int, x double, source string"
KEYS = ["player_id", "date"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, seed, n, players, source):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice([None, *range(players)]), rng.randrange(6), rng.choice([None, rng.random()]), source) for _ in range(n)], SCHEMA)


def files_of(path, buckets=None):
    found = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/_bucket=*/*.parquet")}
    return found if buckets is None else {f: t for f, t in found.items() if int(f.split("_bucket=")[1].split("/")[0]) in buckets}


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable.create(spark, str(tmp_path / "t"), ["player_id"], 12)


def test_batches_equal_upserts_of_the_whole_table(spark, table):
    whole = spark.createDataFrame([], SCHEMA)
    for seed, players in enumerate((40, 5, 80)):
        batch = frame(spark, seed, 120, players, f"b{seed}")
        upsert_buckets(table, batch, KEYS, batch=f"b{seed}")
        whole = sinks.materialize(sinks.upsert(whole, batch, KEYS))
        assert rows_of(table.rows()) == rows_of(whole)
    again = BucketedTable.open(spark, table.path)
    assert again == table and rows_of(again.rows()) == rows_of(whole)


def test_untouched_buckets_keep_their_files(spark, table):
    upsert_buckets(table, frame(spark, 1, 300, 60, "base"), KEYS)
    before = files_of(table.path)
    few = spark.createDataFrame([(3, 1, 0.5, "new"), (900, 1, 0.5, "new")], SCHEMA)
    touched = upsert_buckets(table, few, KEYS)
    assert 1 <= len(touched) <= 2 and len(table.held()) > 6
    after = files_of(table.path)
    others = set(range(12)) - set(touched)
    assert files_of(table.path, others) == {f: t for f, t in before.items() if f in files_of(table.path, others)}
    assert {f for f in before if f not in after} == {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) in touched}
    assert rows_of(table.rows().filter("source = 'new'")) == rows_of(few)


def test_only_touched_buckets_are_read(spark, table):
    upsert_buckets(table, frame(spark, 1, 300, 60, "base"), KEYS)
    some = table.held()[:2]
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in table.rows(some).inputFiles()} <= set(table.held())
    plan = table.rows(some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert rows_of(table.lookup([(3,), (None,), (12345,)])) == rows_of(table.rows().filter("player_id = 3 OR player_id IS NULL"))


def test_a_named_batch_counts_once(spark, table):
    batch = frame(spark, 4, 50, 10, "a")
    assert upsert_buckets(table, batch, KEYS, batch="day-1")
    before = files_of(table.path)
    assert upsert_buckets(table, batch.withColumn("x", F.lit(9.0)), KEYS, batch="day-1") == []
    assert files_of(table.path) == before


def test_a_lost_driver_leaves_a_batch_that_is_put_in_place(spark, table, monkeypatch):
    upsert_buckets(table, frame(spark, 5, 100, 20, "base"), KEYS)
    batch = frame(spark, 6, 30, 20, "late")
    want = rows_of(sinks.upsert(table.rows(), batch, KEYS))

    def lost(self, pending):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_place", lost)
        with pytest.raises(RuntimeError):
            upsert_buckets(table, batch, KEYS, batch="late")
    assert not table.applied("late")
    os.makedirs(f"{table.path}/_pending/half-written/_bucket=1")
    assert table.recover() == 1 and table.applied("late") and rows_of(table.rows()) == want
    assert table.recover() == 0 and not os.listdir(f"{table.path}/_pending")


def test_new_columns_types_and_empty_batches(spark, table):
    assert upsert_buckets(table, spark.createDataFrame([], SCHEMA), KEYS) == [] and table.rows().count() == 0
    upsert_buckets(table, spark.createDataFrame([(k, 1, 1.0, "a") for k in range(30)], SCHEMA), KEYS)
    upsert_buckets(table, spark.createDataFrame([(2, 1, 7, 5)], "player_id int, date int, x int, level int"), KEYS)
    got = {r.player_id: (r.x, r.source, r.level) for r in table.rows().collect()}
    assert got[2] == (7.0, "a", 5) and got[3] == (1.0, "a", None) and len(got) == 30
    assert table.schema().simpleString() == "struct<player_id:bigint,date:int,x:double,source:string,level:int>"
    with pytest.raises(ValueError):
        upsert_buckets(table, spark.createDataFrame([(1, 2.0)], "date int, x double"), ["date"])
    with pytest.raises(ValueError):
        BucketedTable.create(spark, table.path, ["player_id"], 3)


def test_a_frequent_player_is_written_by_several_tasks(spark, table, monkeypatch):
    rows = spark.range(60_000).repartition(8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("player_id"), F.col("id").cast("int").alias("date"),
                                                     F.rand(1).alias("x"), F.lit("s").alias("source"))
    hot = rows.filter("player_id = 7").select(table.bucket_of()).first()[0]
    written, place = [], BucketedTable._place
    monkeypatch.setattr(BucketedTable, "_place", lambda self, pending: (written.extend(glob.glob(f"{pending}/_bucket={hot}/*.parquet")), place(self, pending)))
    # small partitions, so that these few rows come from several tasks as large ones do
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        upsert_buckets(table, rows, KEYS)
    finally:
        for k in small:
            spark.conf.unset(k)
    assert len(written) > 1 and table.rows().count() == 60_000


def features(spark, seed, n):
    rng = random.Random(seed)
    num = lambda: rng.choice([None, round(rng.uniform(0, 1), 3)])
    return spark.createDataFrame(
        [(rng.randrange(25), f"2024-01-{rng.randrange(1, 29):02d}", num(), rng.choice([None, rng.randrange(20)]), num(), num(), rng.randrange(9),
          rng.choice(["PC", "Console", None]), rng.choice(["casual", "whale"])) for _ in range(n)],
        "player_id long, date string, overall_risk_score double, sessions_per_week long, monthly_spent double, total_spent double, friends_online long, platform string, archetype string")


def test_summary_from_batches_equals_the_whole(spark, tmp_path):
    path = str(tmp_path / "states")
    parts = [features(spark, k, 90) for k in range(3)]  # dates of all batches are mixed: late rows
    for k, part in enumerate(parts):
        got = jobs.refresh_summary(spark, path, part, f"day-{k}", buckets=8)
        so_far = parts[0] if k == 0 else parts[0].union(parts[1]) if k == 1 else parts[0].union(parts[1]).union(parts[2])
        want = risk.risk_summary(so_far)
        rounded = lambda df: rows_of(df.select(*want.columns).withColumns({c: F.round(c, 9) for c in ("avg_sessions", "avg_spent")}))
        assert rounded(got) == rounded(want)
    again = jobs.refresh_summary(spark, path, parts[2], "day-2")
    assert rounded(again) == rounded(want)


def test_summary_of_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "states")
    jobs.refresh_summary(spark, path, features(spark, 1, 200), buckets=8)
    before = files_of(path)
    one = features(spark, 2, 40).filter("player_id = 3")
    jobs.refresh_summary(spark, path, one)
    assert len(set(before) - set(files_of(path))) == 1


def test_load_job_takes_runs_by_name(spark, tmp_path):
    path = str(tmp_path / "features")
    first = jobs.etl_load(spark, frame(spark, 1, 80, 20, "a"), path, "a", buckets=4)
    assert first["features_path"] == path and first["buckets"]
    assert jobs.etl_load(spark, frame(spark, 2, 80, 20, "b"), path, "a")["buckets"] == []
    assert jobs.etl_load(spark, frame(spark, 2, 80, 20, "b"), path, "b")["buckets"]
    want = sinks.upsert(frame(spark, 1, 80, 20, "a").transform(lambda d: sinks.upsert(d.limit(0), d, KEYS)), frame(spark, 2, 80, 20, "b"), KEYS)
    assert rows_of(BucketedTable.open(spark, path).rows()) == rows_of(want)
