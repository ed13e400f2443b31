import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from pairgate.operators import linear
from pairgate.operators.ml import GateClassifier, GateModel


def data(spark, n=80):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3)) * [1, 20, 0.1]
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    rows = [(*map(float, v), float(t), list(map(float, v))) for v, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, [float("nan"), 1.0, 1.0])]
    return spark.createDataFrame(rows, "a double, b double, c double, label double, x array<double>")


def test_a_saved_pipeline_scores_like_the_frozen_gate(spark, tmp_path):
    df = data(spark)
    names = ["a", "b", "c"]
    want = linear.freeze(df, names, "label", l2=0.5, target_precision=0.8)
    model = Pipeline(stages=[GateClassifier(inputCols=names, l2=0.5, targetPrecision=0.8)]).fit(df)
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(loaded.stages[0], GateModel) and loaded.stages[0].gate() == want
    out = loaded.transform(df).withColumn("want", want.logit()).collect()
    for r in out[:-1]:
        assert r["logit"] == pytest.approx(r["want"]) and r["prediction"] == float(r["logit"] >= want.threshold)
        assert r["probability"] == pytest.approx(1 / (1 + np.exp(-r["logit"])))
    assert out[-1]["logit"] is None and out[-1]["prediction"] is None
    wide = GateClassifier(featuresCol="x", l2=0.5, targetPrecision=0.8).fit(df)
    got = wide.transform(df).select("logit").collect()
    assert [r["logit"] for r in got[:-1]] == pytest.approx([r["logit"] for r in out[:-1]], abs=1e-6) and got[-1]["logit"] is None


def test_cross_validation_chooses_a_penalty(spark):
    df = data(spark).where("a IS NOT NULL").withColumn("y", F.col("label"))
    estimator = GateClassifier(inputCols=["a"], targetPrecision=0.7)
    grid = ParamGridBuilder().addGrid(estimator.l2, [0.1, 1e6]).build()
    found = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(predictionCol="probability", labelCol="label"), numFolds=2, seed=1
    ).fit(df)
    assert found.bestModel.getOrDefault("reached") == 0.7
    assert found.avgMetrics[0] < found.avgMetrics[1]
