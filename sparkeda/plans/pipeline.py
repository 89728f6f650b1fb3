"""A step pipeline -- transforms, split, train, evaluate -- that stops at the
first failing step and says which one failed.

Unlike the reference, the split happens before any transform is fitted (so
test rows never leak into fitted parameters) and labels are passed for real.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sparkeda.operators.clean import Transform
from sparkeda.operators.learn import classification_metrics, split


@dataclass
class PipelineResult:
    ok: bool
    failed_step: str | None = None
    error: str | None = None
    train: DataFrame | None = None
    test: DataFrame | None = None
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    log: list = field(default_factory=list)


class Pipeline:
    """Ordered steps: ``Transform`` objects (fitted on the training part), then an
    optional model (a ``pyspark.ml`` estimator or a U2 ``Model``) and evaluation."""

    def __init__(self, test_size: float = 0.2, seed: int = 42, split_key: list[str] | None = None):
        self.steps: list = []
        self.model = None
        self.prepare = None
        self.test_size, self.seed, self.split_key = test_size, seed, split_key

    def add_step(self, step: Transform) -> "Pipeline":
        self.steps.append(step)
        return self

    def set_model(self, model, prepare=None) -> "Pipeline":
        """``prepare(df) -> df`` builds ``features`` / ``label`` columns before training."""
        self.model, self.prepare = model, prepare
        return self

    def as_ml(self):
        """The transforms, and a ``pyspark.ml`` model if that is set, as a ``pyspark.ml.Pipeline`` to fit, save and load."""
        from pyspark.ml import Estimator, Pipeline as MlPipeline

        from sparkeda.operators.stages import TransformStage

        model = getattr(self.model, "estimator", self.model)
        return MlPipeline(stages=[*map(TransformStage, self.steps), *([model] if isinstance(model, Estimator) else [])])

    def run(self, df: DataFrame) -> PipelineResult:
        res = PipelineResult(ok=True)
        try:
            train, test = split(df, self.test_size, self.seed, self.split_key)
        except Exception as e:  # noqa: BLE001
            return PipelineResult(ok=False, failed_step="split", error=str(e))
        for i, step in enumerate(self.steps):
            name = f"{i}:{type(step).__name__}"
            try:
                step.fit(train)
                train, test = step.transform(train), step.transform(test)
                res.log.append(f"{name} ok")
            except Exception as e:  # noqa: BLE001
                return PipelineResult(ok=False, failed_step=name, error=f"{type(e).__name__}: {e}", log=res.log)
        res.train, res.test = train, test
        if self.model is not None:
            try:
                tr = self.prepare(train) if self.prepare else train
                te = self.prepare(test) if self.prepare else test
                if hasattr(self.model, "train"):
                    pred = self.model.train(tr).predict(te)
                else:
                    pred = self.model.fit(tr).transform(te)
                res.predictions = pred
                metrics = classification_metrics(pred)
                # evaluated here: a failure is this step's failure
                res.metrics = df.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
                res.log.append("model ok")
            except Exception as e:  # noqa: BLE001
                return PipelineResult(ok=False, failed_step="model", error=f"{type(e).__name__}: {e}", log=res.log,
                                      train=train, test=test)
        return res
