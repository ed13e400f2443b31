"""Gates as Spark ML stages: fitted in a ``Pipeline``, tuned by ``CrossValidator``, saved and loaded.

``GateClassifier`` fits the logistic gate of ``linear`` on named columns (or the one of ``wide`` on one
array column) and freezes its threshold at a precision; ``GateModel`` adds a logit, its probability
and the call.  Rows with an undefined feature get NULL, as everywhere in this package.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate.functions.numeric import all_finite
from pairgate.operators import linear, wide


class _GateParams(HasInputCols, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    logitCol = Param(Params._dummy(), "logitCol", "column of the logit", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column of the probability", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", logitCol="logit", probabilityCol="probability")

    def is_wide(self) -> bool:
        """Whether the features are one array column."""
        return not self.isDefined(self.inputCols)


class GateClassifier(Estimator, _GateParams, DefaultParamsReadable, DefaultParamsWritable):
    """L2 logistic regression with a threshold that reaches ``targetPrecision`` on the rows it saw.

    Give ``inputCols`` for numeric columns or ``featuresCol`` for one array column.
    """

    l2 = Param(Params._dummy(), "l2", "penalty of the squared weights", TypeConverters.toFloat)
    targetPrecision = Param(Params._dummy(), "targetPrecision", "precision of the threshold", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, featuresCol=None, labelCol="label", predictionCol="prediction", logitCol="logit", probabilityCol="probability", l2=1.0, targetPrecision=0.9):
        super().__init__()
        self._setDefault(l2=1.0, targetPrecision=0.9)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> GateModel:
        label, options = self.getLabelCol(), {"l2": self.getOrDefault(self.l2), "target_precision": self.getOrDefault(self.targetPrecision)}
        if self.is_wide():
            gate = wide.freeze(dataset, self.getFeaturesCol(), label, **options)
        else:
            gate = linear.freeze(dataset, self.getInputCols(), label, **options)
        return self._copyValues(GateModel.of(gate, self.is_wide()))


class GateModel(Model, _GateParams, DefaultParamsReadable, DefaultParamsWritable):
    """A frozen gate; its numbers are parameters, so it is saved with any pipeline that holds it."""

    mean = Param(Params._dummy(), "mean", "means of the features", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "deviations of the features", TypeConverters.toListFloat)
    coef = Param(Params._dummy(), "coef", "weights of the standardized features", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    threshold = Param(Params._dummy(), "threshold", "least logit of a call", TypeConverters.toFloat)
    reached = Param(Params._dummy(), "reached", "precision the threshold was chosen for", TypeConverters.toFloat)
    names = Param(Params._dummy(), "names", "names of the features", TypeConverters.toListString)

    @classmethod
    def of(cls, gate: linear.LinearGate, array: bool = False) -> GateModel:
        """The stage of a frozen gate, on its named columns or on one array column."""
        model = cls()
        if not array:
            model._set(inputCols=gate.feature_names)
        model._set(
            mean=gate.mean, std=gate.std, coef=gate.coef, intercept=gate.intercept, threshold=gate.threshold,
            reached=gate.target_precision, names=gate.feature_names,
        )
        return model

    def gate(self) -> linear.LinearGate:
        names = self.getInputCols() if self.isDefined(self.inputCols) else self.getOrDefault(self.names)
        numbers = [self.getOrDefault(p) for p in (self.mean, self.std, self.intercept, self.coef, self.threshold, self.reached)]
        return linear.LinearGate(names, *numbers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gate = self.gate()
        if self.is_wide():
            x = F.col(self.getFeaturesCol()).cast("array<double>")
            weights = [c / s for c, s in zip(gate.coef, gate.std, strict=True)]
            bias = gate.intercept - sum(m * w for m, w in zip(gate.mean, weights, strict=True))
            terms = F.zip_with(x, F.lit(weights), lambda a, b: a * b)
            logit = F.when(wide.usable(self.getFeaturesCol()), F.aggregate(terms, F.lit(bias), lambda t, v: t + v))
        else:
            logit = F.when(all_finite(gate.feature_names), gate.logit())
        scored = dataset.withColumn(self.getOrDefault(self.logitCol), logit)
        z = F.col(self.getOrDefault(self.logitCol))
        called = (z >= gate.threshold).cast("double")
        return scored.withColumn(self.getOrDefault(self.probabilityCol), 1 / (1 + F.exp(-z))).withColumn(self.getPredictionCol(), called)
