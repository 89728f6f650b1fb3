"""The one-call exploratory profile of a dataset."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sparkeda.dataset import Dataset
from sparkeda.operators import profile as P


class Sections(dict):
    """The sections of a profile by name; ``release`` (or leaving a ``with`` block) gives the persisted input back."""

    def __init__(self, source: DataFrame):
        super().__init__()
        self._source = source

    def release(self) -> None:
        self._source.unpersist()

    def __enter__(self) -> "Sections":
        return self

    def __exit__(self, *_) -> None:
        self.release()


def eda(data, bins: int = 20, top: int = 12, exact: bool = True, digits: int | None = 2) -> Sections:
    """Shape, dtypes, describe, nulls, histograms, top values and correlations.

    Sections are skipped when no column qualifies (no numeric columns: no
    describe/histogram; fewer than 2: no correlation; no text: no top values).
    The input is persisted once (memory and disk) for the several passes, until the result's ``release``."""
    df = data.df if isinstance(data, Dataset) else data
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    num, txt = P.numeric_columns(df), P.text_columns(df)
    out = Sections(df)
    out.update({
        "shape": P.shape_metrics(df),
        "dtypes": spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                        "column_name string, type string"),
        "nulls": P.null_profile(df),
    })
    if num:
        out["describe"] = P.describe(df, num, digits=digits, exact=exact)
        out["histogram"] = P.histogram(df, num, bins=bins, exact_median=exact)
    if txt:
        out["top_values"] = P.value_counts(df, txt, top=top)
    if len(num) >= 2:
        out["correlation"] = P.correlation(df, num)
    return out
