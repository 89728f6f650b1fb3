"""Transforms as ``pyspark.ml`` stages.

``TransformStage`` makes any ``Transform`` (the library's or one of one's own) an ``Estimator``; what it learned goes with the
fitted stage, so both can stand in a ``pyspark.ml.Pipeline`` beside other stages and be saved and read back.
"""

from __future__ import annotations

import importlib
import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from sparkeda.operators.clean import Transform


class _HoldsTransform(Params):
    """A transform by its class and its attributes; those must be values that JSON holds."""

    transformClass = Param(Params._dummy(), "transformClass", "module and name of the transform's class", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "attributes of the transform as JSON", TypeConverters.toString)

    def hold(self, transform: Transform):
        cls = type(transform)
        if "." in cls.__qualname__:
            raise ValueError(f"{cls.__qualname__} must be a class of a module, so that it can be read back")
        state = json.dumps(vars(transform), sort_keys=True)
        if json.loads(state) != json.loads(json.dumps(vars(transform))) or _untrue(vars(transform)):
            raise ValueError(f"attributes of {cls.__qualname__} do not survive as JSON")
        return self._set(transformClass=f"{cls.__module__}:{cls.__qualname__}", state=state)

    def transform_object(self) -> Transform:
        module, name = self.getOrDefault("transformClass").split(":")
        made = object.__new__(getattr(importlib.import_module(module), name))
        vars(made).update(json.loads(self.getOrDefault("state")))
        return made


def _untrue(value) -> bool:
    """Whether JSON would change the value: keys that are not text, tuples."""
    if isinstance(value, dict):
        return any(not isinstance(k, str) or _untrue(v) for k, v in value.items())
    return isinstance(value, tuple) or isinstance(value, list) and any(map(_untrue, value))


class TransformStage(_HoldsTransform, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator that fits a ``Transform``."""

    def __init__(self, transform: Transform | None = None):
        super().__init__()
        if transform is not None:
            self.hold(transform)

    def _fit(self, dataset):
        fitted = self.transform_object()
        fitted.fit(dataset)
        return FittedTransform(fitted)


class FittedTransform(_HoldsTransform, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``Transform``."""

    def __init__(self, transform: Transform | None = None):
        super().__init__()
        if transform is not None:
            self.hold(transform)

    def _transform(self, dataset):
        return self.transform_object().transform(dataset)
