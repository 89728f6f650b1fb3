"""Q1: free SQL over registered datasets; the result can itself be registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql(spark: SparkSession, query: str, name: str | None = None, registry=None) -> DataFrame:
    """Run ``query`` with Spark SQL (Catalyst plans it; AQE re-plans at run time).

    A trailing ``;`` is accepted.  With ``name`` the result is registered (K3
    rules when a registry is given, a temp view otherwise)."""
    text = query.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    df = spark.sql(text)
    if name:
        if registry is not None:
            registry.register(df, name=name)
        else:
            df.createOrReplaceTempView(name)
    return df
