"""Q1 acceptance queries: one per SQL category, the same text where dialects agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators.ordered import running
from sparkeda.plans.catalog import ORACLE, register, tbl
from sparkeda.plans.sql_surface import sql
from sparkeda.session import register_tables


def _q(name: str, spark_sql: str, oracle: str | None = None):
    def run(spark, sf_dir):
        register_tables(spark, sf_dir)
        return sql(spark, spark_sql)
    run.__name__ = name
    register(name, oracle if oracle is not None else spark_sql)(run)


_q("q1_filter_project", """
SELECT l_returnflag,
       CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount BETWEEN 0.03 AND 0.07 THEN 'mid' ELSE 'high' END AS band,
       count(*) AS n,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem
WHERE l_quantity BETWEEN 5 AND 45 AND l_linestatus IN ('O', 'F') AND l_returnflag LIKE '%'
GROUP BY 1, 2
""")

_q("q2_join_inner_left", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders,
       round(sum(o_totalprice), 2) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY n_name
""")

_q("q3_join_anti", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")

_q("q4_join_semi", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")

_q("q5_range_join", """
SELECT b.band, count(*) AS n, round(sum(e.value), 2) AS total
FROM events e
JOIN (VALUES ('low', 0.0, 10.0), ('mid', 10.0, 50.0), ('high', 50.0, 1.0e12)) AS b(band, lo, hi)
  ON e.value >= b.lo AND e.value < b.hi
GROUP BY b.band
""")

_q("q6_group_having", """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers,
       round(avg(o_totalprice), 4) AS avg_price
FROM orders GROUP BY o_orderpriority HAVING count(*) > 10
""")

_q("q7_rollup", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")

_q("q7b_cube", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS avg_disc
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")

_q("q8_window_top_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) t
WHERE rn = 1
""")

_q("q9_window_running", """
SELECT event_id, user_id, value,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS value_rank,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running
FROM events
""")

_q("q10_topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")

_q("q11_set_ops", """
SELECT 'both' AS kind, user_id FROM (
  SELECT user_id FROM events WHERE event_type = 'click'
  INTERSECT SELECT user_id FROM events WHERE event_type = 'view') a
UNION ALL
SELECT 'click_only' AS kind, user_id FROM (
  SELECT user_id FROM events WHERE event_type = 'click'
  EXCEPT SELECT user_id FROM events WHERE event_type = 'view') b
UNION ALL
SELECT 'any' AS kind, user_id FROM (
  SELECT user_id FROM events WHERE event_type = 'click'
  UNION SELECT user_id FROM events WHERE event_type = 'view') c
""")

_q("q12_cte_correlated", """
WITH cust AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer)
SELECT n.n_name, c.c_custkey, c.c_acctbal
FROM cust c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM cust c2 WHERE c2.c_nationkey = c.c_nationkey)
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
""")

_q("q13_functions", """
SELECT upper(substring(c.c_name, 1, 8)) AS name8, year(o.o_orderdate) AS yr,
       date_format(date_trunc('MONTH', o.o_orderdate), 'yyyy-MM-dd') AS month_start,
       round(o.o_totalprice / 1000, 1) AS k_price, length(c.c_mktsegment) AS seg_len
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""", """
SELECT upper(substring(c.c_name, 1, 8)) AS name8, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
       strftime(date_trunc('month', o.o_orderdate), '%Y-%m-%d') AS month_start,
       round(o.o_totalprice / 1000, 1) AS k_price, CAST(length(c.c_mktsegment) AS INTEGER) AS seg_len
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")

_q("q14_json_field", """
SELECT CAST(get_json_object(props, '$.k') AS INT) DIV 10 AS k_decile, count(*) AS n,
       round(avg(value), 4) AS avg_value
FROM events GROUP BY 1
""", """
SELECT CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS BIGINT) AS k_decile, count(*) AS n,
       round(avg(value), 4) AS avg_value
FROM events GROUP BY 1
""")


@register("q9_running_chunks", ORACLE["q9_window_running"])
def q9_running_chunks(spark, sf_dir):
    """The same running values by the library's chunks, so that a user with a third of the events is no one task."""
    e = tbl(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    d = running(e, ["user_id"], ["ts", "event_id"], {"prev_value": ("lag", "value"), "running": ("sum", "value")})
    d = running(d, ["user_id"], [F.desc("value"), "event_id"], {"value_rank": ("rank", None)})
    return d.select("event_id", "user_id", "value", "prev_value", F.col("value_rank").cast("int").alias("value_rank"),
                    F.round("running", 4).alias("running"))


K3_SQL = """SELECT 'orders_2024' AS key, count(*) AS rows, 6 AS columns, 'dataframe' AS origin FROM orders
UNION ALL SELECT 'orders_2024_2', count(*), 5, 'dataframe' FROM customer UNION ALL SELECT 'by_status', count(DISTINCT o_orderstatus), 2, 'dataframe' FROM orders"""


@register("k3_registry", K3_SQL)
def k3_registry(spark, sf_dir):
    """Datasets registered under one name, and one made by SQL over a registered name."""
    from sparkeda.sources.registry import Registry, view_name

    reg = Registry(spark)
    key = reg.register(tbl(spark, sf_dir, "orders"), "Orders 2024")
    reg.register(tbl(spark, sf_dir, "customer"), "orders 2024")
    reg.register(sql(spark, f"SELECT o_orderstatus, count(*) AS n FROM {view_name(key)} GROUP BY o_orderstatus"), "by status")
    return reg.list()
