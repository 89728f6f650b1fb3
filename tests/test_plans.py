"""Plan-level guards for the scale properties the README claims."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkeda.operators import clean as C
from sparkeda.operators import profile as P

SF = "/root/testdata/sf0.001"


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_chain_evaluated_once(spark):
    df = spark.createDataFrame([(1, "  A  b "), (2, "   ")], "id int, contenido string")
    out = C.clean_records(df, options=("spaces", "chars", "lower"))
    # squeeze (1) + chars (1) + strip (1): three regex replacements, not repeated in pushed filters
    assert _optimized(out).count("regexp_replace") == 3
    assert [r.contenido for r in out.collect()] == ["a b"]


def test_top_k_uses_window_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.read.parquet(f"{SF}/part.parquet")
        assert "WindowGroupLimit" in _physical(P.value_counts(df, ["p_brand"], top=12))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_pushdown_and_pruning(spark):
    df = E.queries()["q1_filter_project"](spark, SF)
    plan = _physical(df)
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double," in plan


@pytest.mark.parametrize("name", [n for n in sorted(E.oracle_sql()) if n.startswith("q")])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in _physical(E.queries()[name](spark, SF))


def test_spread_only_when_needed(spark):
    from sparkeda.session import spread
    small = spark.read.parquet(f"{SF}/documents.parquet")
    assert spread(small).rdd.getNumPartitions() > 1
    assert spread(small, partitions=1) is small
