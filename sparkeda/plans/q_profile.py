"""Registered profile queries (A1-A13) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import profile as P
from sparkeda.plans.catalog import register, round_doubles, tbl

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# A11 -- the minimum slice
A11_SQL = """
WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag),
     o AS (SELECT avg(mean) AS overall_mean FROM g)
SELECT l_returnflag, round(mean, 4) AS mean, round(overall_mean, 4) AS overall_mean,
       mean >= overall_mean AS above
FROM g, o
"""


@register("a11_group_mean", A11_SQL)
def a11_group_mean(spark, sf_dir):
    return round_doubles(P.group_mean(tbl(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


# A1
A1_SQL = _union([
    f"""SELECT '{c}' AS column_name, count({c}) AS "count", round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
       round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
       round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max FROM lineitem"""
    for c in LINE_NUM])


@register("a1_describe", A1_SQL)
def a1_describe(spark, sf_dir):
    return round_doubles(P.describe(tbl(spark, sf_dir, "lineitem"), LINE_NUM))


# A1b
CUST_TEXT = ["c_name", "c_mktsegment"]
A1B_SQL = _union([
    f"""SELECT '{c}' AS column_name, sum(cnt)::BIGINT AS "count", count(*) AS "unique",
       min(v) FILTER (WHERE cnt = mx) AS top, max(cnt) AS freq
FROM (SELECT v, cnt, max(cnt) OVER () AS mx
      FROM (SELECT {c} AS v, count(*) AS cnt FROM customer WHERE {c} IS NOT NULL GROUP BY {c}))"""
    for c in CUST_TEXT])


@register("a1b_describe_text", A1B_SQL)
def a1b_describe_text(spark, sf_dir):
    return P.describe_text(tbl(spark, sf_dir, "customer"), CUST_TEXT)


# A2 -- nulls derived the same way on both sides (the tables hold none)
NULLY_SQL = """SELECT l_orderkey,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_tax FROM lineitem"""
NULLY_COLS = ["l_orderkey", "l_discount", "l_returnflag", "l_quantity", "l_tax"]


def nully_lineitem(spark, sf_dir):
    li = tbl(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_tax")


A2_SQL = f"""WITH d AS ({NULLY_SQL}), n AS (SELECT count(*) AS r, {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS n_{c}" for c in NULLY_COLS)} FROM d)
""" + _union([f"SELECT '{c}' AS column_name, n_{c} AS nulls, round(n_{c} * 100.0 / r, 2) AS pct FROM n" for c in NULLY_COLS]
             + [f"SELECT '(total)' AS column_name, {' + '.join(f'n_{c}' for c in NULLY_COLS)} AS nulls, "
                f"round(({' + '.join(f'n_{c}' for c in NULLY_COLS)}) * 100.0 / (r * {len(NULLY_COLS)}), 2) AS pct FROM n"])


@register("a2_null_profile", A2_SQL)
def a2_null_profile(spark, sf_dir):
    return P.null_profile(nully_lineitem(spark, sf_dir))


# A3
CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_DUCK_TO_SPARK = ("CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
                  "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(t) END")
A3_SQL = _union([
    f"""SELECT '{c}' AS column_name, {_DUCK_TO_SPARK} AS type, nulls, "distinct" FROM (
  SELECT any_value(typeof({c})) AS t, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
         count(DISTINCT {c}) AS "distinct" FROM customer)""" for c in CUST_COLS])


@register("a3_column_profile", A3_SQL)
def a3_column_profile(spark, sf_dir):
    return P.column_profile(tbl(spark, sf_dir, "customer"))


# A4
A4_SQL = f"""SELECT count(*) AS "rows", 11 AS "columns",
  ({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in LINE_NUM + ['l_returnflag', 'l_linestatus', 'l_shipdate'])})::BIGINT AS nulls,
  8 AS numeric_columns FROM lineitem"""


@register("a4_shape_metrics", A4_SQL)
def a4_shape_metrics(spark, sf_dir):
    return P.shape_metrics(tbl(spark, sf_dir, "lineitem"))


# A6
HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
A6_SQL = f"""
WITH long AS ({_union([f"SELECT '{c}' AS column_name, {c}::DOUBLE AS x FROM lineitem WHERE {c} IS NOT NULL" for c in HIST_COLS])}),
st AS (SELECT column_name, avg(x) AS mean, median(x) AS median,
              CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
       FROM long GROUP BY column_name),
j AS (SELECT l.column_name, x, lo, hi, (hi - lo) / 20 AS step,
             LEAST(CAST(floor((x - lo) * (20.0 / (hi - lo))) AS INTEGER), 19) AS i1
      FROM long l JOIN st USING (column_name)),
j2 AS (SELECT *, CASE WHEN x < (CASE WHEN i1 >= 20 THEN hi ELSE lo + i1 * step END) THEN i1 - 1 ELSE i1 END AS i2 FROM j),
j3 AS (SELECT column_name,
              CASE WHEN x >= (CASE WHEN i2 + 1 >= 20 THEN hi ELSE lo + (i2 + 1) * step END) AND i2 <> 19
                   THEN i2 + 1 ELSE i2 END AS bin FROM j2),
c AS (SELECT column_name, bin, count(*) AS cnt FROM j3 GROUP BY ALL),
grid AS (SELECT column_name, mean, median, lo, hi, CAST(b.range AS INTEGER) AS bin FROM st, range(0, 20) b)
SELECT grid.column_name, grid.bin, round(lo + grid.bin * ((hi - lo) / 20), 4) AS lower,
       round(CASE WHEN grid.bin = 19 THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / 20) END, 4) AS upper,
       coalesce(cnt, 0) AS "count", round(mean, 4) AS mean, round(median, 4) AS median
FROM grid LEFT JOIN c ON grid.column_name = c.column_name AND grid.bin = c.bin
"""


@register("a6_histogram", A6_SQL)
def a6_histogram(spark, sf_dir):
    return round_doubles(P.histogram(tbl(spark, sf_dir, "lineitem"), HIST_COLS, bins=20))


# A7
VC_COLS = ["p_brand", "p_type"]
A7_SQL = f"""
WITH long AS ({_union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL" for c in VC_COLS])}),
g AS (SELECT column_name, value, count(*) AS "count" FROM long GROUP BY ALL)
SELECT column_name, value, "count",
       CAST(row_number() OVER (PARTITION BY column_name ORDER BY "count" DESC, value) AS INTEGER) AS rank
FROM g QUALIFY rank <= 12
"""


@register("a7_value_counts", A7_SQL)
def a7_value_counts(spark, sf_dir):
    return P.value_counts(tbl(spark, sf_dir, "part"), VC_COLS, top=12)


# A8
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(a, b):
    f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    den = f"(stddev_pop({a}) {f} * stddev_pop({b}) {f})"
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN {den} = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) {f} / {den} END, 6) AS corr FROM lineitem")


A8_SQL = _union([_corr_sql(a, b) for a in CORR_COLS for b in CORR_COLS])


@register("a8_correlation", A8_SQL)
def a8_correlation(spark, sf_dir):
    return round_doubles(P.correlation(tbl(spark, sf_dir, "lineitem"), CORR_COLS), 6)


# A10
SCORE_COLS = ["l_quantity", "l_discount", "l_tax"]
A10_SQL = f"""
WITH r AS (SELECT l_suppkey,
  ({' + '.join(f'coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0)' for c in SCORE_COLS)})
  / NULLIF({' + '.join(f'CAST(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL AS INTEGER)' for c in SCORE_COLS)}, 0) AS row_mean
  FROM lineitem)
SELECT l_suppkey, round(avg(row_mean), 4) AS mean_score FROM r GROUP BY l_suppkey
ORDER BY avg(row_mean) DESC NULLS LAST, l_suppkey LIMIT 10
"""


@register("a10_top_by_row_mean", A10_SQL)
def a10_top_by_row_mean(spark, sf_dir):
    return round_doubles(P.top_by_row_mean(tbl(spark, sf_dir, "lineitem"), "l_suppkey", SCORE_COLS, n=10))


# A13
A13_SQL = 'SELECT quality, count(*) AS "count" FROM labels GROUP BY quality'


@register("a13_class_counts", A13_SQL)
def a13_class_counts(spark, sf_dir):
    return P.class_counts(tbl(spark, sf_dir, "labels"), "quality")


A9_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
_A9_DESCRIBE = _union([f"""SELECT '{c}' AS column_name, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c})::DOUBLE AS max FROM lineitem""" for c in A9_NUM])
A9_SQL = _union([
    "SELECT 'shape' AS section, 'rows' AS name, '' AS part, count(*)::DOUBLE AS value FROM lineitem",
    *[f"SELECT 'dtypes', '{c}', '{'string' if c == 'l_returnflag' else 'double'}', 1.0" for c in [*A9_NUM, "l_returnflag"]],
    *[f"SELECT 'nulls', '{c}', '', count(*) FILTER (WHERE {c} IS NULL)::DOUBLE FROM lineitem" for c in [*A9_NUM, "l_returnflag"]],
    *[f"SELECT 'describe', column_name, '{k}', round({k}::DOUBLE, 4) + 0.0 FROM ({_A9_DESCRIBE})" for k in _STATS],
    "SELECT 'top_values', 'l_returnflag', l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag",
    *[f"SELECT 'correlation', col_a, col_b, round(corr, 6) FROM ({_corr_sql(a, b)})" for a in A9_NUM for b in A9_NUM],
    "SELECT 'histogram', column_name, CAST(bin AS VARCHAR), \"count\"::DOUBLE FROM (" + A6_SQL.replace("20", "5").replace("19", "4") + ") WHERE column_name <> 'l_tax'"])


@register("a9_eda_sections", A9_SQL)
def a9_eda_sections(spark, sf_dir):
    """Every section of the profile with its values."""
    from functools import reduce
    from sparkeda.plans.eda import eda

    parts = eda(tbl(spark, sf_dir, "lineitem").select(*A9_NUM, "l_returnflag"), bins=5, digits=None)

    def rows(section, name, part, value):
        return parts[section].select(F.lit(section).alias("section"), F.col(name).alias("name") if isinstance(name, str) else name.alias("name"),
                                     part.cast("string").alias("part"), value.cast("double").alias("value"))

    out = [rows("shape", F.lit("rows"), F.lit(""), F.col("rows")), rows("dtypes", "column_name", F.col("type"), F.lit(1.0)),
           rows("nulls", "column_name", F.lit(""), F.col("nulls")).where("name <> '(total)'"),
           *[rows("describe", "column_name", F.lit(k), F.round(F.col(k).cast("double"), 4)) for k in _STATS],
           rows("top_values", "column_name", F.col("value"), F.col("count")),
           rows("correlation", "col_a", F.col("col_b"), F.round("corr", 6)),
           rows("histogram", "column_name", F.col("bin"), F.col("count")).where("name <> 'l_tax'")]
    return reduce(lambda a, b: a.unionByName(b), out)


S9_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
S9_SQL = f"SELECT * FROM lineitem ORDER BY {', '.join(S9_KEYS)} LIMIT 5"


@register("s9_preview", S9_SQL)
def s9_preview(spark, sf_dir):
    from sparkeda.sources.files import preview
    return preview(tbl(spark, sf_dir, "lineitem").orderBy(*S9_KEYS), 5)


A5_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]
A5_SQL = _union([f"""SELECT '{c}' AS column_name,
  typeof(any_value({c})) IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR typeof(any_value({c})) LIKE 'DECIMAL%' AS "numeric",
  typeof(any_value({c})) = 'VARCHAR' AS "text", count({c}) AS "present" FROM lineitem""" for c in A5_COLUMNS])


@register("a5_column_kinds", A5_SQL)
def a5_column_kinds(spark, sf_dir):
    """Kinds of the columns and how many values each has."""
    li = tbl(spark, sf_dir, "lineitem")
    num, txt = P.numeric_columns(li), P.text_columns(li)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in num).alias("numeric"), F.lit(c in txt).alias("text"),
                                         F.col(f"n_{c}").alias("present")) for c in li.columns])).alias("c")
    return li.agg(*[F.count(c).alias(f"n_{c}") for c in li.columns]).select(cells).select("c.*")
