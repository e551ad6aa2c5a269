"""Learning and scoring (L2-L7, L9-L12, S11) with Spark ML.

Models are ``Pipeline([VectorAssembler, StandardScaler, classifier])``:
training, scoring and explanation all run as Spark jobs over partitions.
Spark ML trees stand in for the boosted-tree libraries (level-wise growth,
loss-based early stopping), so model quality differs from the source's.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.functions.columns import round_to
from retentia.functions.hashing import unit_hash
from retentia.operators.evaluate import evaluate
from retentia.operators.risk import RISK_FACTOR_RULES, risk_band, risk_factors
from retentia.operators.segments import drop_unlabelled, sample_players
from retentia.operators.snapshot import align_features, feature_columns, latest_snapshot, sanitize

LABEL = "churned"


# ---------------------------------------------------------------- L2
def stratified_split(df: DataFrame, target: str = LABEL, test_size: float = 0.2, seed: int = 42,
                     key: str = "player_id", features: list[str] | None = None) -> DataFrame:
    """P3 + P6, then ``split`` = test / train by the hash of (seed, player).

    Exact per label: of each label's rows the ``test_size`` share (rounded) with
    the smallest draws is the test part.  Ranks come from a running count inside
    each of 4,096 draw ranges plus the ranges' own counts before it, so no task
    ranks a whole label.  Re-running gives the same split.
    """
    df = drop_unlabelled(df, target)
    cols = features if features is not None else feature_columns(df)
    parts = 1 << 12
    df = sanitize(df, cols).withColumn("_draw", unit_hash("split", str(seed), F.col(key)))
    df = df.withColumn("_range", F.floor(F.col("_draw") * parts))
    counts = df.groupBy(F.col(target).alias("_label"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    label = Window.partitionBy("_label")  # one row a range
    before = F.sum("_n").over(label.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("_label", "_r", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(label).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(target, "_range").orderBy("_draw", key))
    ranked = df.withColumn("_inside", inside).join(places, (F.col(target) == F.col("_label")) & (F.col("_range") == F.col("_r")))
    test = F.col("_before") + F.col("_inside") <= F.floor(F.col("_all") * F.lit(float(test_size)) + F.lit(0.5))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop(
        "_draw", "_range", "_label", "_r", "_before", "_all", "_inside")


# ---------------------------------------------------------------- L3-L6
def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")


def _scaler() -> StandardScaler:
    # Spark divides by the sample std (scikit-learn: population std); harmless to trees.
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def scale_features(train: DataFrame, features: list[str]) -> PipelineModel:
    """L3 alone: the assembler and the scaler fitted on ``train``; a feature that does not vary there becomes 0."""
    return Pipeline(stages=[_assembler(features), _scaler()]).fit(train)


def scaled(scaler: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``features`` replaced by their scaled values."""
    x = scaler.transform(df).withColumn("features", vector_to_array("features"))
    return x.withColumns({c: F.col("features")[k] for k, c in enumerate(features)}).drop("raw_features", "features")


def boosted(max_iter: int = 200, depth: int = 6, step: float = 0.1, seed: int = 42,
            validation_col: str | None = "is_validation") -> GBTClassifier:
    """L4 stand-in for the gradient-boosting model: depth 6, rate 0.1, 200 rounds, loss-based early stop."""
    kw = dict(labelCol=LABEL, featuresCol="features", maxDepth=depth, stepSize=step, maxIter=max_iter, seed=seed)
    if validation_col:
        kw["validationIndicatorCol"] = validation_col
    return GBTClassifier(**kw)


def random_forest(trees: int = 200, depth: int = 10, min_leaf: int = 4, seed: int = 42) -> RandomForestClassifier:
    """200 trees, depth 10, at least 4 rows per leaf (Spark has no min-split parameter)."""
    return RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, seed=seed)


def boosted_small(max_iter: int = 200, seed: int = 42) -> GBTClassifier:
    """L6 stand-in for the leaf-wise booster (31 leaves ~ depth 5 level-wise): all rows, all rounds, no early stop."""
    return boosted(max_iter=max_iter, depth=5, seed=seed, validation_col=None)


def fit(train: DataFrame, features: list[str], classifier, key: str = "player_id",
        validation_share: float = 0.1) -> PipelineModel:
    """L3 + classifier: assembler → scaler fitted on train → classifier.

    A boosted model with a validation column and none in the data gets a
    hash-chosen validation slice of the training rows (never the test split).
    """
    if isinstance(classifier, GBTClassifier) and classifier.isSet("validationIndicatorCol"):
        vcol = classifier.getValidationIndicatorCol()
        if vcol not in train.columns:
            train = train.withColumn(vcol, unit_hash("validation", F.col(key)) < F.lit(float(validation_share)))
    # A forest's training summary holds the session, which cannot go to the tasks once it has been observed; a copy has none.
    return Pipeline(stages=[_assembler(features), _scaler(), classifier]).fit(train).copy()


def probability(model: PipelineModel, df: DataFrame, out: str = "probability_1") -> DataFrame:
    """Positive-class probability as a double column."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- L7
def ensemble(df: DataFrame, members: list[str], weights: list[float] | dict[str, float] | None = None,
             out: str = "ensemble_probability") -> DataFrame:
    """Weighted sum of member probability columns (equal weights by default); class = probability > 0.5.

    Weights by name may leave members out: those weigh 0.  A name that is no member is an error.
    """
    if not members:
        raise ValueError("ensemble needs at least one member")
    if weights is None:
        weights = {m: 1.0 / len(members) for m in members}
    elif not isinstance(weights, dict):
        if len(weights) != len(members):
            raise ValueError("one weight per member, or weights by name")
        weights = dict(zip(members, weights))
    if unknown := set(weights) - set(members):
        raise ValueError(f"weights for {sorted(unknown)}, members are {members}")
    p: Column = F.lit(0.0)
    for m in members:
        if weights.get(m):
            p = p + F.col(m) * F.lit(float(weights[m]))
    return df.withColumn(out, p).withColumn(f"{out}_class", (F.col(out) > 0.5).cast("int"))


# ---------------------------------------------------------------- L9 / L10
def model_comparison(test: DataFrame, scored_by: dict[str, str], label: str = LABEL) -> DataFrame:
    """L8 rows for each model's probability column, stacked."""
    rows = [evaluate(test, score=col, label=label).withColumn("model", F.lit(name)) for name, col in scored_by.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def feature_importance(model: PipelineModel, features: list[str], n: int = 20) -> DataFrame:
    """The classifier's importances by name, top n (one value per feature: a bounded list)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    df = s.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(n)


def weight_importance(names: list[str], weights: list[float], data: DataFrame, n: int = 20) -> DataFrame:
    """L10 / K0c of a model with weights: each weight's size times its feature's deviation in ``data``, top n."""
    spread = data.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)])
    rows = spread.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(F.lit(float(w))) * F.col(f"s{i}")).alias("importance"))
                                             for i, (c, w) in enumerate(zip(names, weights))])).alias("r")).select("r.*")
    return rows.orderBy(F.col("importance").desc_nulls_last(), "feature").limit(n)


# ---------------------------------------------------------------- L11
def score_latest(features_panel: DataFrame, model: PipelineModel, names: list[str]) -> DataFrame:
    """Latest → align to the model's features → sanitize → probability → band and risk factors."""
    lat = latest_snapshot(features_panel)
    factors = [c for name, _, c, _ in RISK_FACTOR_RULES]
    x = sanitize(align_features(lat, names, keep=("player_id", *[f for f in dict.fromkeys(factors) if f not in names])),
                 names)
    p = risk_factors(probability(model, x, "churn_probability"))
    s = round_to("churn_probability", 4)
    return p.select("player_id", s.alias("churn_probability"), risk_band(round_to("churn_probability", 9)).alias(
        "risk_category"), "top_risk_factors")


def score_panel(panel: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """L11 from raw panel rows: ``pipeline`` is a ``transformers.panel_pipeline``, as fitted or loaded."""
    p = risk_factors(probability(pipeline, panel, "churn_probability"))
    return p.select("player_id", round_to("churn_probability", 4).alias("churn_probability"),
                    risk_band(round_to("churn_probability", 9)).alias("risk_category"), "top_risk_factors")


# ---------------------------------------------------------------- L12
def shapley_values(model: PipelineModel, rows: DataFrame, features: list[str], background: DataFrame,
                   n_rows: int = 100, n_perms: int = 20, seed: int = 42, key: str = "player_id") -> DataFrame:
    """Sampled Shapley values (Strumbelj & Kononenko, 2014) with the background means as reference.

    For each explained row, sampled permutation and feature j, two instances are
    built: the row's values for the features before j in the permutation (with
    and without j), the reference elsewhere.  All instances are scored in one
    ``transform``; the mean difference per (row, feature) is the attribution.
    Work is rows x permutations x features x 2 scorings, all on executors.
    """
    k = len(features)
    rng = random.Random(seed)
    perms = []
    for _ in range(n_perms):
        p = list(range(k))
        rng.shuffle(p)
        pos = [0] * k
        for i, f in enumerate(p):
            pos[f] = i
        perms.append(pos)  # position of each feature in the permutation
    ref = background.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in features]).alias("ref")).select("ref").scalar()
    sample = sample_players(rows, n_rows, seed, key).select(
        key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), ref.alias("ref"))
    pos_arr = F.array(*[F.array(*[F.lit(v) for v in p]) for p in perms])
    inst = sample.select(key, "x", "ref", F.posexplode(pos_arr).alias("perm", "pos")) \
        .select(key, "x", "ref", "perm", "pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    pj = F.element_at("pos", F.col("j") + 1)

    def mix(include_j: bool) -> Column:
        def pick(m, i):
            before = F.element_at("pos", i + 1) < pj
            take = (before | (i == F.col("j"))) if include_j else before
            return F.when(take, m).otherwise(F.element_at("ref", i + 1))
        return F.transform("x", pick)

    pairs = inst.select(key, "j", F.explode(F.array(
        F.struct(F.lit(1.0).alias("sign"), mix(True).alias("v")),
        F.struct(F.lit(-1.0).alias("sign"), mix(False).alias("v")))).alias("s"))
    vec = pairs.select(key, "j", F.col("s.sign").alias("sign"), array_to_vector("s.v").alias("raw_features"))
    tail = PipelineModel(stages=model.stages[1:])
    scored = tail.transform(vec).select(key, "j", "sign", vector_to_array("probability")[1].alias("p"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return scored.groupBy(key, "j").agg((F.sum(F.col("sign") * F.col("p")) / F.lit(float(n_perms))).alias("shap")) \
        .select(key, names.alias("feature"), "shap")


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], label: str = LABEL,
                           seed: int = 42, key: str = "player_id", group_rows: int = 100_000) -> DataFrame:
    """Drop in test accuracy when one feature's values are permuted among the rows.

    Rows are dealt by hash into groups of about ``group_rows`` and ordered by another hash inside; every row takes the
    feature from the row after it, the last from the first: a random permutation without a global order.  The unchanged
    rows (j = -1) and one variant per feature are scored in one batch: rows x (features + 1) scorings, exploded from
    arrays on the executors and reduced to one count a feature before any shuffle.
    """
    k = len(features)
    base = test.select(key, F.col(label).alias("_y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    groups = test.agg(F.ceil(F.count(F.lit(1)) / F.lit(float(group_rows)))).scalar()
    dealt = base.withColumn("_groups", groups).withColumn("_g", F.floor(unit_hash("group", str(seed), F.col(key)) * F.col("_groups")))
    w = Window.partitionBy("_g").orderBy(unit_hash("order", str(seed), F.col(key)), key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = dealt.withColumn("_m", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)))
    ex = base.select("_y", "x", "_m", F.explode(F.sequence(F.lit(-1), F.lit(k - 1))).alias("j"))
    v = F.transform("x", lambda m, i: F.when(i == F.col("j"), F.element_at("_m", i + 1)).otherwise(m))
    given = ex.select("_y", "j", v.alias("_v")).select("_y", "j", *[F.col("_v")[i].alias(c) for i, c in enumerate(features)])
    pred = model.transform(given).select("j", ((F.col("prediction") == F.col("_y")).cast("double")).alias("hit"))
    acc = pred.groupBy("j").agg(F.avg("hit").alias("accuracy"))
    base_acc = acc.filter(F.col("j") == -1).select("accuracy").scalar()
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return acc.filter(F.col("j") >= 0).select(names.alias("feature"), (base_acc - F.col("accuracy")).alias(
        "accuracy_drop"))


# ---------------------------------------------------------------- S11
def save_model(model: PipelineModel, path: str, features: list[str] | None = None, metrics: DataFrame | None = None) -> None:
    """The fitted pipeline, and beside it the feature names in model order and the evaluation rows."""
    model.write().overwrite().save(path)
    if features is not None:
        s = SparkSession.getActiveSession()
        names = s.createDataFrame(list(enumerate(features)), "position int, feature string")
        names.coalesce(1).write.mode("overwrite").json(f"{path}_features")
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").json(f"{path}_metrics")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_features(path: str) -> list[str]:
    """The feature names that were saved beside the model, in model order (a model's list: bounded)."""
    s = SparkSession.getActiveSession()
    return [r.feature for r in s.read.schema("position int, feature string").json(f"{path}_features").orderBy("position").collect()]


def load_metrics(path: str) -> DataFrame:
    return SparkSession.getActiveSession().read.json(f"{path}_metrics")


def pick(models: dict[str, PipelineModel], name: str) -> PipelineModel:
    """The model of that name; an unknown name says which there are."""
    if name not in models:
        raise ValueError(f"no model {name!r}; there are: {', '.join(sorted(models))}")
    return models[name]
