"""Values that must not change on their way: large and missing numbers, close scores, late rows, odd files."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import round_to, score9
from retentia.operators import evaluate as ev
from retentia.operators import model as ml
from retentia.operators.features import serve_features
from retentia.operators.monitor import data_quality, feature_drift
from retentia.sources import sinks
from retentia.sources.panel import events_panel, scan_panel
from retentia.streaming import streams


def test_rounding_keeps_what_it_cannot_round(spark):
    values = [2e13, -2e13, 1e300, float("inf"), float("-inf"), 0.1234567, -0.1234567, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_to("x", 6)).collect()]
    assert got == [2e13, -2e13, 1e300, float("inf"), float("-inf"), 0.123457, -0.123457, None]
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(round_to("x", 6), score9("x")).first()
    assert math.isnan(nan[0]) and math.isnan(nan[1])


def test_auc_and_threshold_use_exact_scores(spark):
    df = spark.createDataFrame([(0.10001, 0), (0.10002, 1), (0.299951, 0)], "s double, y int")
    assert ev.evaluate(df.limit(2), "s", "y").first().roc_auc == 1.0
    at = {round(r.threshold, 2): r for r in ev.cost_curve(df, "s", "y").collect()}
    assert at[0.30].false_positives == 0 and at[0.29].false_positives == 1


def test_cost_curve_at_the_thresholds_themselves(spark):
    scores = [k / 100 for k in range(101)] + [-0.5, 1.5, 0.29, 0.57, 0.58]
    rows = [(s, k % 2) for k, s in enumerate(scores)]
    got = {r.threshold: (r.false_negatives, r.false_positives) for r in ev.cost_curve(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()}
    for k in range(101):
        t = k / 100
        assert got[t] == (sum(1 for s, y in rows if y == 1 and s < t), sum(1 for s, y in rows if y == 0 and s >= t))


def test_auc_equals_all_pairs(spark):
    import random
    rng = random.Random(8)
    rows = [(rng.choice([rng.random(), 0.5, 0.25, 1.0, 0.0, -1.0, 2.0]), rng.randint(0, 1), rng.choice("ab")) for _ in range(400)]
    got = {r.g: r.roc_auc for r in ev.evaluate(spark.createDataFrame(rows, "s double, y int, g string"), "s", "y", by=["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for s, y, h in rows if y == k and h == g] for k in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def test_drift_far_from_zero(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(days=k), 1e9 + (k % 3) * 0.2) for k in range(60)] + [(base + dt.timedelta(days=63), 1e9 + 5.0)]
    r = feature_drift(spark.createDataFrame(rows, "date timestamp_ntz, x double"), ["x"], days=7).first()
    history = [v for d, v in rows if d <= base + dt.timedelta(days=56)]
    mean = sum(history) / len(history)
    assert r.std_history == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in history) / (len(history) - 1)), rel=1e-6)
    assert r.drift


def test_duplicates_by_one_key(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k long")
    got = {r.check: r.failures for r in data_quality(df, ["k"], {}).collect()}
    assert got == {"nulls:k": 2, "duplicate_keys": 3}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "sessions_per_week,archetype,note,player_id,churned,monthly_spent,date\n"
        "7,whale,a,PLAYER_0001,1,12.5,2024-01-02 03:04:05\n3.0,,b,PLAYER_0002,0,NaN,2024-01-03\n")
    a, b = scan_panel(spark, str(tmp_path / "p.csv")).orderBy("player_id").collect()
    assert (a.player_id, a.archetype, a.sessions_per_week, a.monthly_spent, a.churned, a.country, a.note) == ("PLAYER_0001", "whale", 7, 12.5, 1, None, "a")
    assert (a.date, b.sessions_per_week, b.archetype, b.monthly_spent) == (dt.datetime(2024, 1, 2, 3, 4, 5), 3, None, None)
    (tmp_path / "bad.csv").write_text("player_id,sessions_per_week\nx,3.5\n")
    with pytest.raises(Exception, match="not a whole number"):
        scan_panel(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(ValueError, match="player_id"):
        (tmp_path / "none.csv").write_text("a,b\n1,2\n")
        scan_panel(spark, str(tmp_path / "none.csv"))


def test_nan_in_a_parquet_panel_is_missing(spark, tmp_path):
    spark.createDataFrame([(1, float("nan"))], "player_id long, win_rate double").write.parquet(str(tmp_path / "p"))
    assert scan_panel(spark, str(tmp_path / "p")).first().win_rate is None


def test_unreadable_props_fail_nothing_and_ties_go_by_event(spark):
    ts = dt.datetime(2024, 1, 1, 5)
    rows = [(k, ts, 1, "view", 1.0, p) for k, p in enumerate(['{"k": "x"}', '{"k": 1.5}', '{"k": true}', '{"k": 99999999999}', '{"k": 7}', None])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    nation = spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string")
    r = events_panel(events, nation).first()
    assert r.sessions_per_week == 6 and r.content_completion_pct == pytest.approx(7 / 99)
    assert r.days_since_last_login is None  # the last event (largest id at the same time) has no k
    r = events_panel(events.filter("event_id < 5"), nation).first()
    assert r.days_since_last_login == 7


def test_upsert_last_wins_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k long, v string, only_here int")
    updates = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "w", 0), (3, "z", 1), (None, "m", 5)], "k long, v string, at int")
    got = sorted(sinks.upsert(target, updates, ["k"], order="at").select("k", "v", "at", "only_here").collect(), key=lambda r: (r.k is None, r.k))
    assert [tuple(r) for r in got] == [(1, "y", 2, 10), (2, "b", None, 20), (3, "z", 1, None), (None, "m", 5, 0)]


def test_conform_does_not_lose_large_numbers(spark):
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    with pytest.raises(Exception, match="(?i)overflow"):
        sinks.conform(spark.createDataFrame([(3_000_000_000,)], "x long"), schema).collect()
    assert sinks.conform(spark.createDataFrame([("7",), ("seven",)], "x string"), schema).collect() == [(7,), (None,)]


def test_request_without_a_required_value_has_no_score(spark):
    r = serve_features(spark.createDataFrame([(None, 30.0, 1)], "sessions_per_week int, avg_session_length_mins double, days_since_last_login int")).first()
    assert r.engagement_score is None and r.engagement_risk is None and r.overall_risk_score is None


def test_split_is_exact_per_label(spark):
    df = spark.createDataFrame([(k, float(k), int(k % 7 == 0)) for k in range(1000)], "player_id long, f double, churned int")
    rows = ml.stratified_split(df, features=["f"]).collect()
    for label in (0, 1):
        own = [r.split for r in rows if r.churned == label]
        assert own.count("test") == math.floor(0.2 * len(own) + 0.5)
    assert len(rows) == 1000


def test_ensemble_with_some_weights_and_unknown_names(spark):
    df = spark.createDataFrame([(0.2, 0.8)], "a double, b double")
    assert ml.ensemble(df, ["a", "b"], {"b": 0.5}).first().ensemble_probability == pytest.approx(0.4)
    with pytest.raises(ValueError, match="c"):
        ml.ensemble(df, ["a", "b"], {"c": 1.0})
    with pytest.raises(ValueError, match="forest"):
        ml.pick({"forest": None, "boosted": None}, "tree")


def test_model_is_saved_with_names_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k % 5), float(k % 3), k % 2) for k in range(60)], "player_id long, a double, b double, churned int")
    model = ml.fit(df, ["b", "a"], ml.random_forest(trees=3, depth=2, min_leaf=1))
    metrics = ev.evaluate(ml.probability(model, df, "p"), "p", "churned")
    ml.save_model(model, str(tmp_path / "m"), ["b", "a"], metrics)
    assert ml.load_features(str(tmp_path / "m")) == ["b", "a"]
    assert ml.load_metrics(str(tmp_path / "m")).first().rows == 60
    drop = {r.feature: r.accuracy_drop for r in ml.permutation_importance(ml.load_model(str(tmp_path / "m")), df, ["b", "a"]).collect()}
    assert set(drop) == {"a", "b"}


def test_state_survives_a_new_checkpoint(spark, tmp_path):
    schema = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("date", T.TimestampNTZType()), T.StructField("v", T.DoubleType())])
    rows = [[(1, dt.datetime(2024, 1, 1), 1.0)], [(2, dt.datetime(2024, 1, 2), 2.0)], [(1, dt.datetime(2024, 1, 9), 9.0), (3, dt.datetime(2024, 1, 3), 3.0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"src{k // 2}" / f"f{k}"))
    run = lambda k: {r.player_id: r.v for r in streams.run_latest_stream(
        spark, str(tmp_path / f"src{k}" / "*"), schema, str(tmp_path / "state"), str(tmp_path / f"checkpoint{k}"), ttl_days=60,
        now="2024-01-20 00:00:00", compact_every=1).collect()}
    assert run(0) == {1: 1.0, 2: 2.0}
    assert run(1) == {1: 9.0, 2: 2.0, 3: 3.0}  # its batches count from 0 again, the state's numbers go on
    assert len(streams._numbers(spark, str(tmp_path / "state" / "deltas"))) <= 2  # those that a base covers are gone


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from retentia import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
