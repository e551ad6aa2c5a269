"""Models, sinks, jobs and streams: behaviour checks (these have no exact SQL twin)."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from retentia.operators import model as ml
from retentia.operators.features import serve_features
from retentia.operators.snapshot import latest_snapshot, prepare_model_data
from retentia.plans import frames
from retentia.sources import sinks
from retentia.sources.panel import flatten_profiles, ingest
from retentia.sources.schemas import PANEL, PLAYER_FEATURES
from retentia.streaming import streams


@pytest.fixture(scope="module")
def trained(spark):
    data, cols = prepare_model_data(frames.features(spark, SMALL))
    split = ml.stratified_split(data, features=cols)
    model = ml.fit(split, cols, ml.random_forest(trees=10, depth=4, min_leaf=1))
    return model, cols, split


def test_split_is_deterministic_and_covers_rows(trained):
    _, _, split = trained
    a = sorted(map(tuple, split.select("player_id", "split").collect()))
    b = sorted(map(tuple, split.repartition(5).select("player_id", "split").collect()))
    assert a == b and {s for _, s in a} <= {"train", "test"}


def test_probabilities_and_ensemble(trained):
    model, cols, split = trained
    p = ml.probability(model, split, "p")
    vals = [r.p for r in p.select("p").collect()]
    assert all(0.0 <= v <= 1.0 for v in vals)
    e = ml.ensemble(p.withColumn("q", F.lit(1.0)), ["p", "q"], [0.25, 0.75]).select("p", "ensemble_probability")
    for r in e.collect():
        assert r.ensemble_probability == pytest.approx(0.25 * r.p + 0.75)
    with pytest.raises(ValueError):
        ml.ensemble(p, [])


def test_shapley_efficiency(spark, trained):
    """Per row, attributions sum to f(x) - f(reference) for sampled permutations (telescoping)."""
    model, cols, split = trained
    shap = ml.shapley_values(model, split, cols, split, n_rows=5, n_perms=4)
    sums = {r.player_id: r.s for r in shap.groupBy("player_id").agg(F.sum("shap").alias("s")).collect()}
    ref = split.agg(*[F.avg(c).alias(c) for c in cols])
    f_ref = ml.probability(model, ref.withColumn("player_id", F.lit(-1)), "p").collect()[0].p
    fx = {r.player_id: r.p for r in ml.probability(model, split, "p").select("player_id", "p").collect()}
    assert len(sums) == 5
    for pid, s in sums.items():
        assert s == pytest.approx(fx[pid] - f_ref, abs=1e-9)


def test_a_forest_scores_after_the_session_was_observed(spark, trained):
    from pyspark.sql import Observation

    _, cols, split = trained
    seen = Observation()
    split.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    model = ml.fit(split, cols, ml.random_forest(trees=2, depth=2, min_leaf=1))
    assert not model.stages[-1].hasSummary
    assert ml.probability(model, split, "p").filter("p BETWEEN 0 AND 1").count() == seen.get["n"]


def test_importance_and_save_load(spark, trained, tmp_path):
    model, cols, split = trained
    imp = ml.feature_importance(model, cols, 5).collect()
    assert len(imp) == 5 and imp[0].importance >= imp[-1].importance
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    a = ml.probability(model, split, "p").select("player_id", "p").orderBy("player_id").collect()
    b = ml.probability(again, split, "p").select("player_id", "p").orderBy("player_id").collect()
    assert a == b


def test_upsert_replaces_whole_rows(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, v string, x double")
    u = spark.createDataFrame([(2, "B", None), (3, "c", 3.0)], "k long, v string, x double")
    out = sorted(map(tuple, sinks.upsert(t, u, ["k"]).collect()))
    assert out == [(1, "a", 1.0), (2, "B", None), (3, "c", 3.0)]


def test_conform_casts_and_fills(spark):
    df = spark.createDataFrame([("7", "x", 1)], "sessions_per_week string, archetype string, extra int")
    out = sinks.conform(df, PLAYER_FEATURES)
    r = out.collect()[0]
    assert r.sessions_per_week == 7 and r.player_id is None and r.extra == "1"
    assert dict(out.dtypes)["sessions_per_week"] == "int"


def test_kv_snapshot_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "player_id long, a double, b double")
    r = sinks.feature_kv_snapshot(df, now="2024-01-01 00:00:00").collect()[0]
    assert r.key == "player:1" and json.loads(r.value) == {"player_id": 1, "a": None, "b": 2.5}
    kv = sinks.prediction_kv(spark.createDataFrame([(1, 0.8, "High")], "player_id long, churn_probability double, "
                                                    "risk_category string"), now="2024-01-01 00:00:00")
    assert sinks.lookup(kv, ["player:1:prediction"], "2024-01-01 00:59:00").count() == 1
    assert sinks.lookup(kv, ["player:1:prediction"], "2024-01-01 01:00:01").count() == 0


def test_flatten_profiles(spark, tmp_path):
    rows = [
        {"steamid": "1", "summary": {"timecreated": 0, "lastlogoff": 86400, "communityvisibilitystate": 3},
         "friends": [{"steamid": "2"}, {"steamid": "3"}],
         "games": [{"appid": 730, "playtime_forever": 100, "playtime_2weeks": 5}, {"appid": 1, "playtime_forever": 9}],
         "playerstats": {"achievements": [{"name": "a", "achieved": 1}, {"name": "b", "achieved": 0}]}},
        {"steamid": "2", "summary": {"timecreated": 10}, "friends": [], "games": [{"appid": 1, "playtime_forever": 3}],
         "playerstats": {"achievements": []}},
    ]
    p = tmp_path / "payloads.json"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    from retentia.sources.schemas import PROFILE_PAYLOAD

    out = {r.player_id: r for r in flatten_profiles(spark.read.schema(PROFILE_PAYLOAD).json(str(p)), 730).collect()}
    assert (out["1"].friend_count, out["1"].owned_games, out["1"].target_playtime_total,
            out["1"].target_playtime_2weeks, out["1"].achievements) == (2, 2, 100, 5, 2)  # achieved or not
    # the target game is absent: no play time rather than 0; no payload has lastlogoff here
    assert (out["2"].friend_count, out["2"].target_playtime_total, out["2"].achievements, out["2"].last_logoff) == (0, None, 0, None)


def test_ingest_errors(spark):
    with pytest.raises(ValueError):
        ingest(spark, "nope")
    with pytest.raises(ValueError):
        ingest(spark, "csv")


def test_stream_latest_late_rows_do_not_win(spark, tmp_path):
    import datetime as dt
    schema = "player_id long, date timestamp_ntz, v double"
    src = str(tmp_path / "src")
    d8, d1 = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, d8, 1.0), (2, d8, 5.0)], schema).coalesce(1).write.mode("append").parquet(src)
    # a late row for player 1, older than what the state already holds
    spark.createDataFrame([(1, d1, 9.0)], schema).coalesce(1).write.mode("append").parquet(src)
    from pyspark.sql import types as T
    st = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("date", T.TimestampNTZType()),
                       T.StructField("v", T.DoubleType())])
    out = streams.run_latest_stream(spark, src, st, str(tmp_path / "state"), str(tmp_path / "ck"), ttl_days=30,
                                    now="2024-01-20 00:00:00", max_files_per_trigger=1)
    got = {r.player_id: r.v for r in out.collect()}
    assert got == {1: 1.0, 2: 5.0}


def test_stream_score(spark, tmp_path):
    lat = serve_features(latest_snapshot(frames.panel(spark, SMALL)))
    names = ["sessions_per_week", "engagement_score", "overall_risk_score", "activity_risk"]
    model = ml.fit(lat, names, ml.random_forest(trees=5, depth=3, min_leaf=1))
    src = str(tmp_path / "src")
    frames.panel(spark, SMALL).write.parquet(src)
    streams.run_score_stream(spark, src, PANEL, model, names, str(tmp_path / "sink"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert out.count() == frames.panel(spark, SMALL).count()
    assert out.filter(~F.col("risk_category").isin("Low", "Medium", "High")).count() == 0


def test_data_quality_counts_duplicates(spark):
    from retentia.operators.monitor import data_quality
    df = spark.createDataFrame([(1, 1, 0.5), (1, 1, 2.0), (1, 2, None), (2, 1, 0.1)], "player_id long, date long, x double")
    got = {r.check: r.failures for r in data_quality(df, ["player_id", "date"], {"x": (0.0, 1.0)}).collect()}
    assert got["duplicate_keys"] == 1 and got["nulls:x"] == 1 and got["out_of_range:x"] == 1


def test_uncommitted_compaction_is_ignored(spark, tmp_path):
    """A base without its commit marker (a crash mid-compaction) is not read."""
    import datetime as dt
    state = str(tmp_path / "state")
    d1, d2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)
    b0 = spark.createDataFrame([(1, d1, 1.0)], "player_id long, date timestamp_ntz, v double")
    b1 = spark.createDataFrame([(1, d2, 2.0)], "player_id long, date timestamp_ntz, v double")
    streams.fold_batch(spark, b0, 0, state, 30, "2024-01-10 00:00:00", compact_every=1)  # committed base c=0
    streams.fold_batch(spark, b1, 1, state, 30, "2024-01-10 00:00:00", compact_every=0)  # delta only
    # a broken, uncommitted base for batch 1 claims an older value
    b0.write.parquet(f"{state}/base/c=1")
    got = streams.current_state(spark, state, 30, "2024-01-10 00:00:00").collect()
    assert [(r.player_id, r.v) for r in got] == [(1, 2.0)]


def test_drift_without_history_is_null_not_an_error(spark):
    import datetime as dt
    from retentia.operators.monitor import feature_drift
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 8), 1.0), (2, dt.datetime(2024, 1, 9), None)],
                               "player_id long, date timestamp_ntz, x double")
    r = feature_drift(df, ["x"], days=7).collect()[0]
    assert r.mean_current == 1.0 and r.mean_history is None and r.drift is False


def test_iso_timestamps_like_python(spark):
    import datetime as dt
    from retentia.sources.sinks import iso_timestamp
    vals = [dt.datetime(2024, 1, 1, 0, 43, 12, 370659), dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame([(v,) for v in vals], "t timestamp_ntz")
    assert [r[0] for r in df.select(iso_timestamp("t")).collect()] == [v.isoformat() for v in vals]


def test_ingest_json_uses_the_declared_schema(spark, tmp_path):
    from retentia.sources.schemas import PANEL
    frames.panel(spark, SMALL).write.json(str(tmp_path / "p"))
    df = ingest(spark, "json", path=str(tmp_path / "p"))
    assert df.schema == PANEL or [f.name for f in df.schema] == PANEL.fieldNames()
    assert df.count() == frames.panel(spark, SMALL).count()
