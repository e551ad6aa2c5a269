"""Sketches kept by day, and figures gathered while writing."""

import glob
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retentia.operators import monitor
from retentia.operators import sketches as sk
from retentia.plans import jobs
from retentia.sources import sinks

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20_000), datetime(2024, 1, 1) + timedelta(days=rng.randrange(6)), rng.choice([None, float("nan"), rng.gauss(5, 2), rng.gauss(5, 2), 7.0]),
             float(k % 97), rng.choice(["PC", "Mobile"])) for k in range(30_000)]
    return spark.createDataFrame(rows, "player_id long, date timestamp_ntz, x double, y double, platform string").checkpoint()


def test_quantiles_of_any_period_are_within_the_stated_error(panel):
    stored = sk.daily_quantiles(panel, ["x", "y"], ["platform"]).checkpoint()
    assert stored.count() == 6 * 2 * 2
    for first, last in ((None, None), ("2024-01-02", "2024-01-04"), ("2024-01-06", None)):
        rows = panel.filter((F.to_date("date") >= (first or "2000-01-01")) & (F.to_date("date") <= (last or "2100-01-01")))
        found = sk.period_quantiles(sk.in_period(stored, first, last), [0.0, 0.1, 0.5, 0.8, 1.0]).checkpoint()
        checked = sk.off_by(rows, found, ["x", "y"]).collect()
        assert len(checked) == 10 and all(r.off <= 2 * sk.rank_error() for r in checked)
        assert {(r.metric, r.n) for r in checked} == {("x", rows.filter("x IS NOT NULL AND NOT isnan(x)").count()), ("y", rows.count())}
    by = sk.period_quantiles(stored, [0.5], ["platform"])
    assert by.columns == ["platform", "metric", "n", "rank", "edge"] and by.count() == 4


def test_histograms_and_the_spender_cut(spark, panel):
    stored = sk.daily_quantiles(panel, ["y"]).checkpoint()
    for r in sk.period_histogram(stored, 10).collect():
        assert (r.bin_lo, r.bin_hi) == (pytest.approx((r.bin - 1) * 9.6), pytest.approx(r.bin * 9.6))
        want = panel.filter((F.col("y") >= r.bin_lo) & ((F.col("y") < r.bin_hi) | (F.lit(r.bin) == 10))).count() / 30_000
        assert abs(r.share - want) <= 2 * sk.rank_error() + 2 / sk.STEPS
    same = spark.createDataFrame([(datetime(2024, 1, 1), 3.0)] * 5, "date timestamp_ntz, z double")
    assert [r.share for r in sk.period_histogram(sk.daily_quantiles(same, ["z"]), 3).orderBy("bin").collect()] == [1.0, 0.0, 0.0]
    cut = panel.select(sk.spender_cut(stored, 0.2, "y").alias("c")).first().c
    assert abs(cut - 0.8 * 97) <= 97 * 2 * sk.rank_error() + 1
    none = sk.daily_quantiles(same.withColumn("z", F.lit(None).cast("double")), ["z"])
    assert sk.period_quantiles(none, [0.5]).collect() == [] and sk.period_histogram(none).collect() == []


def test_distinct_players_of_any_period(panel):
    stored = sk.daily_players(panel.union(panel.withColumn("player_id", F.lit(None).cast("long")))).checkpoint()
    exact = lambda rows: {r[0] for r in rows.select("player_id").distinct().collect()}
    day = lambda d: panel.filter(F.to_date("date") == d)
    a, b = exact(day("2024-01-01")), exact(day("2024-01-02"))
    got = sk.overlap(sk.in_period(stored, "2024-01-01", "2024-01-01"), sk.in_period(stored, "2024-01-02", "2024-01-02")).first()
    assert tuple(got) == (len(a), len(b), len(a & b), len(a - b), len(b - a))  # few enough for theta sketches to be exact
    whole, one = len(exact(panel)), sk.period_players(stored).first()
    for n in one:
        assert abs(n - whole) <= 4 * sk.distinct_error() * whole
    assert tuple(sk.overlap(sk.in_period(stored, "2030-01-01"), sk.in_period(stored, last="2024-01-01")).first()) == (0, len(a), 0, 0, len(a))
    assert sk.period_players(sk.daily_players(panel, ["platform"]), ["platform"]).count() == 2


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_and_predictions_are_gathered_while_writing(spark, panel, tmp_path):
    ranges, flags = {"y": (0.0, 50.0), "x": (4.0, 6.0)}, ["platform_flag"]
    df = panel.withColumn("platform_flag", F.when(F.col("platform") == "PC", 1).otherwise(2))
    frame, rows = monitor.observe_quality(df, ranges, flags)
    sinks.write_table(frame, str(tmp_path / "a"), sort_within=["player_id"])
    back = spark.read.parquet(str(tmp_path / "a"))
    got = rows().unionByName(monitor.duplicate_keys(back, ["player_id", "date"]))
    assert rows_of(got) == rows_of(monitor.data_quality(df, ["player_id", "date"], ranges, flags))

    pred = panel.select("player_id", (F.col("y") / 97).alias("churn_risk_score"), F.when(F.col("y") > 60, "High").when(F.col("y") > 20, "Medium").otherwise("Low").alias("risk_category"))
    frame, row = monitor.observe_predictions(pred, "2024-02-01")
    sinks.write_predictions(frame, str(tmp_path / "p"))
    a, b = row().first(), monitor.prediction_distribution(pred, "2024-02-01").first()
    assert a.asDict().keys() == b.asDict().keys()
    assert all(x == pytest.approx(y) for x, y in zip(a, b))
    none = pred.limit(0)
    frame, row = monitor.observe_predictions(none, "2024-02-01")
    sinks.write_predictions(frame, str(tmp_path / "n"))
    assert tuple(row().first()) == tuple(monitor.prediction_distribution(none, "2024-02-01").first())


@pytest.mark.parametrize("bucketed", [False, True])
def test_the_load_job_reports_quality(spark, bucketed):
    out = jobs.etl_run(spark, SMALL, bucketed=bucketed, table_name="features_checked", checked={"win_rate": (0.0, 0.5)})
    feats = spark.table("features_checked") if bucketed else spark.read.parquet(out["features_path"])
    assert rows_of(out["quality"]) == rows_of(monitor.data_quality(feats, ["player_id", "date"], {"win_rate": (0.0, 0.5)}))


def test_written_files_are_sorted_by_player_and_date(spark, panel, tmp_path):
    sinks.write_table(panel, str(tmp_path / "s"), sort_within=["player_id", "date"])
    files = glob.glob(f"{tmp_path}/s/*.parquet")
    assert files
    for f in files:
        t = pq.read_table(f, columns=["player_id", "date"]).to_pydict()
        keys = list(zip(t["player_id"], t["date"]))
        assert keys == sorted(keys)
