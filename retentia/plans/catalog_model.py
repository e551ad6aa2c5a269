"""Registered queries: split, ensemble, training, importance, scoring and explanation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentia.operators import model as ml
from retentia.operators import risk, transformers
from retentia.operators.segments import split_churn_rates
from retentia.operators.snapshot import prepare_model_data
from retentia.plans import frames
from retentia.plans import oracle as O
from retentia.plans.catalog_features import D, _k9_expr
from retentia.plans.registry import query
from retentia.sources.sinks import materialize, stage_path, to_daily_predictions

SEED, TEST_SIZE = 42, 0.2


def _model_data(spark, sf, materialized: bool = False):
    """The split model snapshot; written once to the shared checkpoint folder when models iterate over it."""
    data, cols = prepare_model_data(frames.features(spark, sf))
    split = ml.stratified_split(data, features=cols, test_size=TEST_SIZE, seed=SEED)
    return (materialize(split) if materialized else split), cols


@query("split_churn_rates", "L2 A19 P3", O.with_latest(f"""
, rk AS (SELECT churned, row_number() OVER (PARTITION BY churned ORDER BY {O.unit_hash("'split'", f"'{SEED}'", 'player_id')}, player_id) AS r,
              count(*) OVER (PARTITION BY churned) AS n FROM latest WHERE churned IS NOT NULL),
sp AS (SELECT churned, CASE WHEN r <= floor(n * {D(TEST_SIZE)} + 0.5) THEN 'test' ELSE 'train' END AS split FROM rk)
SELECT split, count(*) AS rows, {O.r6('avg(churned)')} AS churn_rate FROM sp GROUP BY split"""))
def q_split(spark, sf):
    """Hash split 80/20 of the model snapshot: rows and churn rate per part."""
    data, _ = _model_data(spark, sf)
    return split_churn_rates(data)


@query("ensemble_scores", "L7", O.with_latest(f"""
, m AS (SELECT player_id, {O.r6(O.score9('overall_risk_score'))} AS risk_score, {_k9_expr()} AS rule_probability
        FROM latest),
e AS (SELECT *, 0.0 + risk_score * 0.5 + rule_probability * 0.5 AS p FROM m)
SELECT player_id, risk_score, rule_probability, {O.r6('p')} AS ensemble_probability,
  CAST(p > 0.5 AS INTEGER) AS ensemble_probability_class FROM e"""))
def q_ensemble(spark, sf):
    """Equal-weight ensemble of two given scores: the risk score and the rule-based probability."""
    lat = risk.rule_churn_probability(frames.latest(spark, sf), out="rule_probability")
    from retentia.functions.columns import round6, score9
    m = lat.select("player_id", round6(score9("overall_risk_score")).alias("risk_score"), "rule_probability")
    return ml.ensemble(m, ["risk_score", "rule_probability"])


def _train_all(spark, sf):
    data, cols = _model_data(spark, sf, materialized=True)
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    models = {"boosted": ml.fit(train, cols, ml.boosted()), "random_forest": ml.fit(train, cols, ml.random_forest()),
              "boosted_small": ml.fit(train, cols, ml.boosted_small())}
    scored = test
    for name in models:
        scored = ml.probability(ml.pick(models, name), scored, f"p_{name}")
    scored = ml.ensemble(scored, [f"p_{n}" for n in models], out="p_ensemble")
    # Score the test split once; the four evaluations below then read the written scores.
    return models, cols, materialize(scored.select("player_id", "churned", *[f"p_{n}" for n in models], "p_ensemble"))


@query("model_comparison", "L3 L4 L5 L6 L7 L8 L9")
def q_models(spark, sf):
    """Three models (reference settings) and their equal-weight ensemble, evaluated on the hash test split."""
    models, _, scored = _train_all(spark, sf)
    cols = {n: f"p_{n}" for n in models} | {"ensemble": "p_ensemble"}
    return ml.model_comparison(scored, cols)


@query("feature_importance", "L10 L5 K0c")
def q_importance(spark, sf):
    """Top-20 feature importances of the random forest."""
    data, cols = _model_data(spark, sf, materialized=True)
    m = ml.fit(data.filter(F.col("split") == "train"), cols, ml.random_forest())
    return ml.feature_importance(m, cols, 20)


@query("score_latest", "L11 K2 S13")
def q_score(spark, sf):
    """Batch scoring as daily_predictions rows: forest probability, band and top risk factors per player."""
    data, cols = _model_data(spark, sf, materialized=True)
    m = ml.fit(data.filter(F.col("split") == "train"), cols, ml.random_forest())
    scored = ml.score_latest(frames.features(spark, sf), m, cols)
    return to_daily_predictions(scored, "random_forest-r1", "2024-02-01")


@query("explain_shapley", "L12")
def q_explain(spark, sf):
    """Sampled Shapley attributions (100 rows x 20 permutations) of the random forest's probability."""
    data, cols = _model_data(spark, sf, materialized=True)
    train = data.filter(F.col("split") == "train")
    m = ml.fit(train, cols, ml.random_forest())
    return ml.shapley_values(m, data.filter(F.col("split") == "test"), cols, train, n_rows=100, n_perms=20)


@query("permutation_importance", "L12")
def q_perm(spark, sf):
    """Accuracy drop per feature when its values are permuted among the test rows (random forest)."""
    data, cols = _model_data(spark, sf, materialized=True)
    m = ml.fit(data.filter(F.col("split") == "train"), cols, ml.random_forest())
    return ml.permutation_importance(m, data.filter(F.col("split") == "test"), cols)


# ---------------------------------------------------------------- a model with given weights, which SQL can express
CARD = {"overall_risk_score": 3.5, "engagement_score": -1.25, "friends_online": -0.05, "days_since_last_login": 0.04,
        "session_decay_rate": 0.6, "monthly_spent": -0.0015, "win_rate_std": 0.3}
CARD_INTERCEPT = -1.4


def card_model() -> PipelineModel:
    return PipelineModel([transformers.Scorecard(names=list(CARD), weights=list(CARD.values()), intercept=CARD_INTERCEPT)])


def card_sql(columns: dict[str, float] | None = None) -> str:
    """Twin of the scorecard's probability over sanitized columns."""
    points = D(CARD_INTERCEPT)
    for c, w in (columns or CARD).items():
        x = f"CAST({c} AS DOUBLE)"
        points = f"({points} + CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END * {D(w)})"
    return f"(1.0 / (1.0 + exp(-{points})))"


def factor_count_sql() -> str:
    tests = {"sessions_per_week": "< 2", "days_since_last_login": "> 14", "session_decay_rate": "> 0.3", "friends_online": "< 2", "days_since_last_purchase": "> 90"}
    return " + ".join(O.flag(f"{c} {t}") for c, t in tests.items())


def card_scores(columns: str, source: str) -> str:
    return (f"SELECT {columns}, {O.rnd('p', 4)} AS churn_probability, {O.band(O.score9('p'))} AS risk_category, factors AS n_factors "
            f"FROM (SELECT *, {card_sql()} AS p, {factor_count_sql()} AS factors FROM {source})")


def with_factor_count(scored):
    return scored.withColumn("n_factors", F.size("top_risk_factors")).drop("top_risk_factors")


@query("panel_pipeline", "S11 L11 F32 W7 P6 P7 K2", O.with_latest(card_scores("player_id", "latest")))
def q_panel_pipeline(spark, sf):
    """A pipeline from panel rows to scores, saved, loaded anew and applied to the raw panel (scorecard model)."""
    path = stage_path(spark, "panel-model")
    ml.save_model(transformers.panel_pipeline(card_model(), list(CARD)), path)
    return with_factor_count(ml.score_panel(frames.panel(spark, sf), ml.load_model(path)))


@query("score_latest_card", "L11 S13 K2", O.with_latest(f"""
SELECT md5(CAST(player_id AS VARCHAR) || ':2024-02-01:card-1') AS prediction_id, CAST(player_id AS VARCHAR) AS player_id,
  TIMESTAMP '2024-02-01' AS prediction_date, churn_probability, risk_category, 'card-1' AS model_version, n_factors
FROM ({card_scores("player_id", "latest")})"""))
def q_score_card(spark, sf):
    """Batch scoring as daily_predictions rows by the scorecard."""
    scored = ml.score_latest(frames.features(spark, sf), card_model(), list(CARD))
    return with_factor_count(to_daily_predictions(scored, "card-1", "2024-02-01"))


SCALED = ["sessions_per_week", "engagement_score", "monthly_spent", "win_rate_std"]


def _split_sql(select: str) -> str:
    """The model snapshot with its split (``split_churn_rates`` has the same rule), then ``select`` over ``sp``."""
    return O.with_latest(f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY {O.unit_hash("'split'", f"'{SEED}'", 'player_id')}, player_id) AS r,
              count(*) OVER (PARTITION BY churned) AS n FROM latest WHERE churned IS NOT NULL),
sp AS (SELECT *, CASE WHEN r <= floor(n * {D(TEST_SIZE)} + 0.5) THEN 'test' ELSE 'train' END AS split FROM rk) {select}""")


def _clean(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END)"


@query("scaled_features", "L3", _split_sql(
    ", m AS (SELECT " + ", ".join(f"avg({_clean(c)}) AS m_{c}, stddev_samp({_clean(c)}) AS s_{c}" for c in SCALED) + " FROM sp WHERE split = 'train') "
    "SELECT player_id, split, " + ", ".join(O.r6(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({_clean(c)} - m_{c}) / s_{c} END") + f" AS {c}" for c in SCALED) + " FROM sp, m"))
def q_scaled(spark, sf):
    """Features scaled to mean 0 and deviation 1 of the training part."""
    data, _ = _model_data(spark, sf, materialized=True)
    scaler = ml.scale_features(data.filter(F.col("split") == "train"), SCALED)
    return ml.scaled(scaler, data, SCALED).select("player_id", "split", *SCALED)


def _comparison_sql() -> str:
    from retentia.plans.catalog_evaluate import metrics_select

    parts = {"card": card_sql(), "rules": _k9_expr(), "risk": "overall_risk_score"}
    scores = ", ".join(f"{O.r6(e)} AS p_{n}" for n, e in parts.items())
    tables = f", t0 AS (SELECT player_id, churned, {scores} FROM sp WHERE split = 'test')\n, t AS (SELECT *, 0.0 + p_card * {D(1 / 3)} + p_rules * {D(1 / 3)} + p_risk * {D(1 / 3)} AS p_ensemble FROM t0)"
    return _split_sql(tables + " " + " UNION ALL ".join(f"SELECT * FROM ({metrics_select(n, f'p_{n}', 't')})" for n in (*parts, "ensemble")))


@query("model_comparison_card", "L9 L7 L8 L2", _comparison_sql())
def q_comparison_card(spark, sf):
    """Scorecard, rules and risk score with their equal-weight ensemble, evaluated on the hash test split."""
    data, _ = _model_data(spark, sf, materialized=True)
    test = data.filter(F.col("split") == "test")
    from retentia.functions.columns import round6
    lat = risk.rule_churn_probability(frames.latest(spark, sf), out="p_rules").select("player_id", "p_rules")
    scored = ml.probability(card_model(), test, "p_card").join(lat, "player_id")
    scored = scored.select("player_id", "churned", *[round6(c).alias(n) for c, n in (("p_card", "p_card"), ("p_rules", "p_rules"), ("overall_risk_score", "p_risk"))])
    scored = materialize(ml.ensemble(scored, ["p_card", "p_rules", "p_risk"], out="p_ensemble"))
    return ml.model_comparison(scored, {n: f"p_{n}" for n in ("card", "rules", "risk", "ensemble")})


@query("importance_card", "L10 K0c", _split_sql(
    ", m AS (SELECT " + ", ".join(f"stddev_samp({_clean(c)}) AS s_{c}" for c in CARD) + " FROM sp WHERE split = 'train'), r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({D(w)}) * s_{c} AS importance FROM m" for c, w in CARD.items())
    + f") SELECT feature, {O.r6('importance')} AS importance FROM (SELECT * FROM r ORDER BY importance DESC, feature LIMIT 5)"))
def q_importance_card(spark, sf):
    """Top 5 of the scorecard's features by weight times deviation in the training part."""
    data, _ = _model_data(spark, sf)
    return ml.weight_importance(list(CARD), list(CARD.values()), data.filter(F.col("split") == "train"), 5)


def _permutation_sql() -> str:
    order = f"{O.unit_hash("'order'", f"'{SEED}'", 'player_id')}, player_id"
    group = f"floor({O.unit_hash("'group'", f"'{SEED}'", 'player_id')} * ceil((SELECT count(*) FROM sp WHERE split = 'test') / 100000.0))"
    clean = ", ".join(f"{_clean(c)} AS {c}" for c in CARD)
    moved = ", ".join(f"coalesce(lead({c}) OVER w, first_value({c}) OVER w) AS m_{c}" for c in CARD)
    hit = lambda changed: f"avg(CAST((({card_sql({(f'm_{c}' if c == changed else c): v for c, v in CARD.items()})}) > 0.5) = (churned = 1) AS INTEGER))"
    drops = " UNION ALL ".join(f"SELECT '{c}' AS feature, {hit(None)} - {hit(c)} AS drop_ FROM x" for c in CARD)
    return _split_sql(f""", t AS (SELECT player_id, churned, {group} AS g, {clean} FROM sp WHERE split = 'test'),
x AS (SELECT *, {moved} FROM t WINDOW w AS (PARTITION BY g ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT feature, {O.r6('drop_')} AS accuracy_drop FROM ({drops})""")


@query("permutation_card", "L12", _permutation_sql())
def q_perm_card(spark, sf):
    """Accuracy drop of the scorecard per feature when its values are permuted among the test rows."""
    data, _ = _model_data(spark, sf, materialized=True)
    return ml.permutation_importance(card_model(), data.filter(F.col("split") == "test"), list(CARD), seed=SEED)
