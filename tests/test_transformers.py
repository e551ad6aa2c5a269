"""One saved pipeline from panel rows to scores: stages, parameters, a load in a new process."""

import math
import subprocess
import sys

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentia.operators import model as ml
from retentia.operators import transformers as tr
from retentia.operators.features import engineer_all, serve_features
from retentia.operators.snapshot import latest_snapshot, prepare_model_data
from retentia.plans import frames

SMALL = "/root/testdata/sf0.001"
ROOT = ml.__file__.rsplit("/", 3)[0]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def panel(spark):
    return frames.panel(spark, SMALL).checkpoint()


def test_stages_do_what_their_operators_do(panel):
    feats = tr.EngineerFeatures().transform(panel)
    assert rows_of(feats.select("player_id", "date", "overall_risk_score")) == rows_of(engineer_all(panel).select("player_id", "date", "overall_risk_score"))
    assert rows_of(tr.LatestSnapshot().transform(panel)) == rows_of(latest_snapshot(panel))
    assert rows_of(tr.LatestSnapshot(key="platform", order="date").transform(panel.select("platform", "date"))) == rows_of(latest_snapshot(panel.select("platform", "date"), "platform"))
    served = tr.ServeFeatures().transform(panel)
    assert rows_of(served.select("player_id", "date", "overall_risk_score")) == rows_of(serve_features(panel).select("player_id", "date", "overall_risk_score"))
    aligned = tr.AlignFeatures(names=["win_rate", "nowhere"], keep=["player_id", "win_rate", "absent"]).transform(panel)
    assert aligned.columns == ["player_id", "win_rate", "nowhere"] and aligned.filter("nowhere <> 0.0").count() == 0
    odd = panel.sparkSession.createDataFrame([(float("nan"), None), (float("inf"), 2.0)], "a double, b double")
    assert rows_of(tr.SanitizeFeatures(names=["a"]).transform(odd)) == [(0.0, 2.0), (0.0, None)]


def test_scorecard(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (-300.0, 900.0)], "a double, b double")
    card = tr.Scorecard(names=["a", "b"], weights=[0.5, -1.0], intercept=0.25)
    for r in ml.probability(PipelineModel([card]), df, "p").collect():
        x = 0.25 + 0.5 * r.a - r.b
        assert abs(r.p - (1 / (1 + math.exp(-x)) if x > -700 else 0.0)) < 1e-15
    assert [r.prediction for r in card.transform(df).collect()] == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        tr.Scorecard(names=["a"], weights=[]).transform(df)


def test_a_trained_pipeline_is_equal_in_a_new_process(spark, panel, tmp_path):
    data, names = prepare_model_data(engineer_all(panel))
    forest = ml.fit(data.filter("churned IS NOT NULL"), names, ml.random_forest(trees=5, depth=3))
    whole = tr.panel_pipeline(forest, names)
    model, out, rows = str(tmp_path / "model"), str(tmp_path / "scores"), str(tmp_path / "panel")
    ml.save_model(whole, model)
    panel.write.parquet(rows)
    want = ml.score_panel(spark.read.parquet(rows), whole)
    assert rows_of(want) == rows_of(ml.score_latest(engineer_all(panel), forest, names))
    code = ("from retentia.session import local_session\nfrom retentia.operators import model as ml\n"
            f"s = local_session(2)\nml.score_panel(s.read.parquet({rows!r}), ml.load_model({model!r})).write.parquet({out!r})")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, timeout=300)
    assert rows_of(spark.read.parquet(out)) == rows_of(want)
    loaded = ml.load_model(model)
    assert [type(s).__name__ for s in loaded.stages[:4]] == ["EngineerFeatures", "LatestSnapshot", "AlignFeatures", "SanitizeFeatures"]
    assert loaded.stages[2].getOrDefault("names") == names


def test_a_serving_pipeline_scores_every_row(panel, tmp_path):
    card = PipelineModel([tr.Scorecard(names=["engagement_score", "monthly_spent"], weights=[-2.0, -0.01], intercept=0.5)])
    path = str(tmp_path / "served")
    ml.save_model(tr.panel_pipeline(card, ["engagement_score", "monthly_spent"], serving=True), path)
    got = ml.score_panel(panel, ml.load_model(path))
    assert got.count() == panel.count() and got.filter("churn_probability IS NULL OR risk_category IS NULL").count() == 0


def test_scaling_uses_the_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = ml.scale_features(train, ["a", "b"])
    got = ml.scaled(scaler, train.union(spark.createDataFrame([(7.0, 9.0)], train.schema)).withColumn("c", F.lit("x")), ["a", "b"])
    assert got.columns == ["a", "b", "c"]
    assert [round(r.a, 6) for r in got.orderBy("a").collect()] == [-0.707107, 0.707107, 3.535534]
    assert {r.b for r in got.collect()} == {0.0}
