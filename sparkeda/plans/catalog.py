"""Catalogue of registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the driver tables over their whole extent.  Floating results are rounded the
same way on both sides so the value hashes can agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkeda.session import ensure_shipped, read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# tables whose rows carry whole texts: regex work per row is CPU-heavy
TEXT_TABLES = {"documents", "conversations", "pages"}
#: rows a task gets at most, where a Python parse holds a task's batch of them
TASK_ROWS = {"pages": 2000}


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shipped(spark)  # executors must import the package for the Python helpers
    df = read_table(spark, sf_dir, name)
    return spread(df, rows=TASK_ROWS.get(name)) if name in TEXT_TABLES else df


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double/float column (both sides of an oracle check do the same)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def load_all() -> None:
    """Import every query module so its ``register`` calls run."""
    from sparkeda.plans import (q_sql, q_profile, q_clean, q_nested, q_web, q_pages, q_learn)  # noqa: F401
