"""Transforms as stages of a pyspark.ml pipeline."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sparkeda.operators.clean import Imputer, Scaler, Transform
from sparkeda.operators.learn import decision_tree
from sparkeda.operators.stages import TransformStage
from sparkeda.plans.pipeline import Pipeline as Steps


class Shift(Transform):
    """A transform of a user."""

    def __init__(self, col, by=None):
        self.col, self.by = col, by

    def fit(self, df):
        self.by = df.agg(F.max(self.col)).first()[0]
        return self

    def transform(self, df):
        return df.withColumn(self.col, F.col(self.col) - F.lit(self.by))


def test_fitted_stages_are_read_back(spark, tmpdir_path):
    df = spark.createDataFrame([(1.0, 10.0, "a"), (None, 20.0, "b"), (3.0, 60.0, None)], "x double, y double, t string")
    p = Pipeline(stages=[TransformStage(Imputer("mode", ["t"])), TransformStage(Imputer("mean")), TransformStage(Scaler("minmax", ["y"])), TransformStage(Shift("x"))])
    p.write().save(f"{tmpdir_path}/unfitted")
    fitted = Pipeline.load(f"{tmpdir_path}/unfitted").fit(df)
    fitted.write().save(f"{tmpdir_path}/fitted")
    want = [(-2.0, 0.0, "a"), (-1.0, 0.2, "b"), (0.0, 1.0, "a")]
    for model in (p.fit(df), PipelineModel.load(f"{tmpdir_path}/fitted")):
        assert [tuple(r) for r in model.transform(df).collect()] == want


def test_steps_as_stages(spark):
    df = spark.createDataFrame([(float(k % 5), float(k % 2)) for k in range(40)], "x double, label double")
    from sparkeda.operators.learn import assemble
    ml = Steps().add_step(Scaler("zscore", ["x"])).set_model(decision_tree()).as_ml()
    assert len(ml.getStages()) == 2
    fitted = Pipeline(stages=ml.getStages()[:1]).fit(df)
    assert fitted.transform(df).agg(F.avg("x")).first()[0] == pytest.approx(0)
    decision_tree().fit(assemble(fitted.transform(df), ["x"]))


def test_state_must_survive():
    class Inner(Transform):
        def fit(self, df):
            return self

        def transform(self, df):
            return df
    with pytest.raises(ValueError):
        TransformStage(Inner())
    bad = Shift("x")
    bad.by = {1: 2}
    with pytest.raises(ValueError):
        TransformStage(bad)
