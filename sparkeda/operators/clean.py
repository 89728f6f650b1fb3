"""Record cleaning (T6-T8, T11), null handling and scaling (N1-N4, N6), and the
user-transform base class (U1).

Fitting is one aggregate pass whose result is a small dict of scalars per
column; transforming is a single projection of Column expressions.
"""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkeda.functions import text as X
from sparkeda.operators.profile import NUMERIC_TYPES, _long_strings, exact_quantiles, numeric_columns, present

TEXT_FIELDS = ("contenido", "texto", "nombre", "alt", "titulo")
CLEAN_ORDER = ("html", "spaces", "chars", "lower", "dates")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# ------------------------------------------------------------------- T6-T8, T11
def clean_column(col, options) -> Column:
    """The T1-T5 steps chosen in ``options``, always in the fixed order."""
    c = col
    if "html" in options:
        c = X.strip_html(c)
    if "spaces" in options:
        c = X.squeeze_spaces(c)
    if "chars" in options:
        c = X.drop_special_chars(c)
    if "lower" in options:
        c = X.lower_trim(c)
    if "dates" in options:
        c = X.iso_dates(c)
    return c


def computed_once(df: DataFrame, exprs: dict) -> DataFrame:
    """Replace columns by expressions evaluated exactly once per row.

    The expressions are produced by a one-element ``inline`` (a Generate), so a
    later filter on them cannot be pushed below and re-evaluate them (plain
    projections get inlined into pushed-down filters by the optimizer)."""
    if not exprs:
        return df
    keep = [c for c in df.columns if c not in exprs]
    gen = F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()])))
    return df.select(*[_q(c) for c in keep], gen).select(*[_q(c) for c in df.columns])


def clean_records(df: DataFrame, options=CLEAN_ORDER, fields=TEXT_FIELDS, keep_kinds=None,
                  kind_col: str = "tipo") -> DataFrame:
    """Clean the text fields present, optionally drop duplicates (``"duplicates"``
    in options), then always drop records whose text fields are all empty (T8)."""
    opts = set(options)
    present = [f for f in fields if f in df.columns and isinstance(df.schema[f].dataType, T.StringType)]
    out = computed_once(df, {f: clean_column(_q(f), opts) for f in present})
    if "duplicates" in opts:
        out = drop_duplicate_records(out)
    return drop_empty_records(out, fields=present, keep_kinds=keep_kinds, kind_col=kind_col)


def drop_duplicate_records(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Whole-record equality (nulls equal).  A hash aggregate, combined map-side."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def drop_empty_records(df: DataFrame, fields=TEXT_FIELDS, keep_kinds=None, kind_col: str = "tipo") -> DataFrame:
    """Keep rows with at least one non-empty text field.  Rows with none of the
    fields (e.g. social links, price-only products) are dropped, as in the
    reference, unless their kind is listed in ``keep_kinds``."""
    present = [f for f in fields if f in df.columns]
    cond = reduce(lambda a, b: a | b, [X.non_empty(_q(f)) for f in present], F.lit(False))
    if keep_kinds and kind_col in df.columns:
        cond = cond | _q(kind_col).isin(list(keep_kinds))
    return df.where(cond)


def limit_records(df: DataFrame, n: int, order_by=("page_id", "tipo", "position")) -> DataFrame:
    """The first ``n`` records in a stated order (repeatable)."""
    keys = [c for c in order_by if c in df.columns] or df.columns[:1]
    return df.orderBy(*keys).limit(n)


# ------------------------------------------------------------------------- U1
class Transform(ABC):
    """A user transform with ``fit`` / ``transform`` / ``fit_transform``."""

    @abstractmethod
    def fit(self, df: DataFrame) -> "Transform":
        ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


# ------------------------------------------------------------------------- N1/N2
class Imputer(Transform):
    """Fill nulls with the column mean, median or mode; ``drop`` removes rows.

    Defaults to numeric columns; unknown columns are ignored; mean/median on a
    text column is skipped with a warning; an all-null column is left as it is
    for mean/median.  Mode takes the most frequent value, ties -> smallest; an
    all-null column gets mode 0, as the reference does."""

    def __init__(self, strategy: str = "mean", cols: list[str] | None = None):
        if strategy not in ("mean", "median", "mode", "drop"):
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy = strategy
        self.cols = cols
        self.values_: dict = {}

    def fit(self, df: DataFrame) -> "Imputer":
        self.values_ = {}
        if self.strategy == "drop":
            return self
        cols = [c for c in (self.cols or numeric_columns(df)) if c in df.columns]
        if self.strategy in ("mean", "median"):
            skipped = [c for c in cols if not _is_numeric(df, c)]
            for c in skipped:
                warnings.warn(f"skipped '{c}' for {self.strategy}: not numeric")
            cols = [c for c in cols if c not in skipped]
        if not cols:
            return self
        if self.strategy == "mean":
            row = df.agg(*[F.avg(present(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
            self.values_ = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        elif self.strategy == "median":
            q = exact_quantiles(df, cols, (0.5,))
            self.values_ = {c: q[c][0.5] for c in cols}
        else:
            g = _long_strings(df, cols, keep_nulls=False).groupBy("column_name", "value").agg(
                F.count("*").alias("cnt"))
            # ties -> smallest value, compared as numbers for numeric columns
            num_cols = [c for c in cols if _is_numeric(df, c)]
            as_num = F.when(F.col("column_name").isin(num_cols), F.col("value").try_cast("double")) \
                if num_cols else F.lit(None).cast("double")
            best = g.groupBy("column_name").agg(
                F.min(F.struct((-F.col("cnt")).alias("neg"), as_num.alias("num"), F.col("value").alias("v"))).alias("b"))
            found = {r["column_name"]: r["b"]["v"] for r in best.collect()}
            self.values_ = {c: found.get(c, "0") for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "drop":
            return drop_nulls(df, self.cols)
        fills = {}
        for c, v in self.values_.items():
            if v is None or c not in df.columns:
                continue
            dt = df.schema[c].dataType
            lit = F.lit(v).cast(dt) if self.strategy == "mode" else F.lit(float(v)).cast(
                dt if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)) else T.DoubleType())
            fills[c] = F.coalesce(present(df, c), lit) if self.strategy == "mode" or isinstance(
                dt, (T.DoubleType, T.FloatType, T.DecimalType)) else F.coalesce(present(df, c).cast("double"), lit)
        return df.withColumns(fills) if fills else df


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``cols`` (all columns when None)."""
    subset = [c for c in cols if c in df.columns] if cols else None
    return df.na.drop(how="any", subset=subset)


# ------------------------------------------------------------------------- N3/N4
class Scaler(Transform):
    """N3 ``zscore`` (sample std) / N4 ``minmax`` on numeric columns.

    A std (or range) of 0 or null divides by 1; a null mean (or min) subtracts 0,
    so a constant column becomes 0 and an all-null column stays null."""

    def __init__(self, method: str = "zscore", cols: list[str] | None = None):
        if method not in ("zscore", "minmax"):
            raise ValueError(f"unknown method {method}")
        self.method = method
        self.cols = cols
        self.params_: dict = {}

    def fit(self, df: DataFrame) -> "Scaler":
        cols = [c for c in (self.cols or numeric_columns(df)) if c in df.columns]
        skipped = [c for c in cols if not _is_numeric(df, c)]
        for c in skipped:
            warnings.warn(f"skipped '{c}' in scaler: not numeric")
        cols = [c for c in cols if c not in skipped]
        self.params_ = {}
        if not cols:
            return self
        aggs = []
        for i, c in enumerate(cols):
            x = present(df, c).cast("double")
            if self.method == "zscore":
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"b{i}")]
            else:
                aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            a, b = row[f"a{i}"], row[f"b{i}"]
            if self.method == "zscore":
                self.params_[c] = {"mean": a, "std": b}
            else:
                self.params_[c] = {"min": a, "max": b}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, p in self.params_.items():
            if c not in df.columns:
                continue
            if self.method == "zscore":
                shift = p["mean"] if p["mean"] is not None else 0.0
                scale = p["std"] if p["std"] not in (None, 0) else 1.0
            else:
                shift = p["min"] if p["min"] is not None else 0.0
                rng = None if p["min"] is None or p["max"] is None else p["max"] - p["min"]
                scale = rng if rng not in (None, 0) else 1.0
            exprs[c] = (present(df, c).cast("double") - F.lit(float(shift))) / F.lit(float(scale))
        return df.withColumns(exprs) if exprs else df


# ---------------------------------------------------------------------------- N6
def threshold_label(df: DataFrame, col: str, threshold: float | None = None, name: str = "label") -> DataFrame:
    """1 where ``col >= threshold`` (default: the exact median), else 0; null -> 0."""
    if threshold is None:
        threshold = exact_quantiles(df, [col], (0.5,))[col][0.5]
    cond = (_q(col).cast("double") >= F.lit(threshold)) if threshold is not None else F.lit(False)
    return df.withColumn(name, F.coalesce(cond.cast("int"), F.lit(0)))
