"""The feature operators as ML stages, so that one saved pipeline goes from panel rows to a score.

Each stage only adds projections, windows or aggregates to the plan; its parameters are written as JSON with the
pipeline and read back by class name, in any process that can import this module.  ``panel_pipeline`` puts the stages
before a fitted model; ``Scorecard`` is a model whose weights are given rather than learnt.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators import snapshot
from retentia.operators.features import engineer_all, serve_features
from retentia.operators.risk import RISK_FACTOR_RULES

#: Columns that the risk factors (K2) read, kept beside the model's features.
FACTOR_COLUMNS = tuple(dict.fromkeys(c for _, _, c, _ in RISK_FACTOR_RULES))


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage without inputs of its own to declare: it takes the columns that its operator takes."""

    def _take(self, values: dict) -> None:
        """Set what was given."""
        self._set(**{k: v for k, v in values.items() if v is not None})


class EngineerFeatures(_Stage):
    """F32: the eight feature stages on panel rows."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return engineer_all(dataset)


class ServeFeatures(_Stage):
    """the request-time features of rows without history."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return serve_features(dataset)


class LatestSnapshot(_Stage):
    """Each key's last non-null values by ``order``."""

    key = Param(Params._dummy(), "key", "column that names a player", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "column that orders a player's rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, key: str = None, order: str = None) -> None:
        super().__init__()
        self._setDefault(key="player_id", order="date")
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return snapshot.latest_snapshot(dataset, self.getOrDefault(self.key), self.getOrDefault(self.order))


class AlignFeatures(_Stage):
    """The columns ``names`` in that order, absent ones 0.0, after those of ``keep`` that the frame has."""

    names = Param(Params._dummy(), "names", "feature names in the model's order", TypeConverters.toListString)
    keep = Param(Params._dummy(), "keep", "other columns to pass on", TypeConverters.toListString)

    @keyword_only
    def __init__(self, names: list[str] = None, keep: list[str] = None) -> None:
        super().__init__()
        self._setDefault(names=[], keep=["player_id"])
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.names)
        return snapshot.align_features(dataset, names, keep=tuple(k for k in self.getOrDefault(self.keep) if k not in names))


class SanitizeFeatures(_Stage):
    """Null, NaN and infinities become 0 in ``names``."""

    names = Param(Params._dummy(), "names", "columns to clean", TypeConverters.toListString)

    @keyword_only
    def __init__(self, names: list[str] = None) -> None:
        super().__init__()
        self._setDefault(names=[])
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return snapshot.sanitize(dataset, self.getOrDefault(self.names))


class Scorecard(_Stage):
    """A logistic score with given weights: ``probability`` is the vector (1 - p, p), ``prediction`` whether p exceeds one half.

    The points are added from the intercept on, in the order of ``names``.
    """

    names = Param(Params._dummy(), "names", "feature names", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "one weight a feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "points of a row of zeros", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, names: list[str] = None, weights: list[float] = None, intercept: float = None) -> None:
        super().__init__()
        self._setDefault(names=[], weights=[], intercept=0.0)
        self._take(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, weights = self.getOrDefault(self.names), self.getOrDefault(self.weights)
        if len(names) != len(weights):
            raise ValueError("a scorecard needs one weight a feature")
        points = F.lit(self.getOrDefault(self.intercept))
        for n, w in zip(names, weights):
            points = points + F.col(n).cast("double") * F.lit(w)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-points))
        return (dataset.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")))


def panel_pipeline(model: PipelineModel, names: list[str], keep: tuple[str, ...] = ("player_id", *FACTOR_COLUMNS),
                   serving: bool = False) -> PipelineModel:
    """Panel rows to a score in one pipeline: features, latest row of each player, model columns, then ``model``.

    With ``serving`` the rows carry no history: request-time features, and every row is scored.
    """
    before = [ServeFeatures()] if serving else [EngineerFeatures(), LatestSnapshot()]
    return PipelineModel([*before, AlignFeatures(names=list(names), keep=list(keep)), SanitizeFeatures(names=list(names)), *model.stages])
