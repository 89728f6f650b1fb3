"""The data model: a named, lazy DataFrame with provenance."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dataset:
    """A named DataFrame plus where it came from.

    ``df`` stays lazy; inspection helpers run small jobs only when called.
    """

    name: str
    df: DataFrame
    origin: str = ""
    loaded_at: _dt.datetime = field(default_factory=lambda: _dt.datetime.now(_dt.timezone.utc))
    metadata: dict = field(default_factory=dict)

    def with_df(self, df: DataFrame, **changes) -> "Dataset":
        return replace(self, df=df, **changes)

    # inspection --------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return list(self.df.columns)

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    def head(self, n: int = 5) -> DataFrame:
        return self.df.limit(n)

    def info(self) -> dict:
        return {"name": self.name, "origin": self.origin,
                "columns": [(f.name, f.dataType.simpleString()) for f in self.df.schema.fields],
                "loaded_at": self.loaded_at.isoformat(), **self.metadata}


class DatasetSplit(NamedTuple):
    """Train and test parts of one dataset (names get ``_train`` / ``_test``)."""

    train: Dataset
    test: Dataset
