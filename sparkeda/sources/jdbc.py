"""JDBC sources (S5-S8, S10): whole tables, arbitrary queries, the catalogue.

Reads are lazy and partitioned: with a numeric ``partition_column`` and
bounds, Spark issues ``num_partitions`` range queries in parallel; filters and
column selections applied later are pushed into the remote SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _dialect(url: str) -> str:
    u = url.lower()
    for d in ("sqlite", "mysql", "postgresql", "derby", "h2", "sqlserver", "oracle"):
        if u.startswith(f"jdbc:{d}"):
            return d
    return "generic"


def _reader(spark: SparkSession, url: str, properties: dict | None):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r


#: Types of java.sql.Types that a read can be split by.
_WHOLE = (-6, 5, 4, -5, 2, 3)


def _catalogue(spark: SparkSession, url: str, table: str, properties: dict | None) -> tuple[list[tuple], list[str]]:
    """What the driver's own catalogue says of a table, on any dialect: its columns ``(name, type, nullable, default, type number, digits
    after the point)`` and its primary key.  Names are arguments, never part of a SQL text; the case that the database stores is found."""
    jvm = spark.sparkContext._jvm
    props = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        if k == "driver":
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(v)
        else:
            props.setProperty(k, str(v))
    con = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        meta = con.getMetaData()
        schema, _, name = table.rpartition(".")
        for case in (str, str.upper, str.lower):
            own = case(schema) if schema else con.getSchema()
            rows, found = meta.getColumns(con.getCatalog(), own, case(name), None), []
            while rows.next():
                if rows.getString("TABLE_NAME") != case(name):  # the catalogue takes names as patterns
                    continue
                found.append((rows.getInt("ORDINAL_POSITION"), rows.getString("COLUMN_NAME"), rows.getString("TYPE_NAME"), rows.getInt("NULLABLE") != 0,
                              rows.getString("COLUMN_DEF"), rows.getInt("DATA_TYPE"), rows.getInt("DECIMAL_DIGITS")))
            if found:
                keys, key = meta.getPrimaryKeys(con.getCatalog(), own, case(name)), []
                while keys.next():
                    key.append((keys.getInt("KEY_SEQ"), keys.getString("COLUMN_NAME")))
                return [f[1:] for f in sorted(found)], [k for _, k in sorted(key)]
        return [], []
    finally:
        con.close()


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = "key",
               lower_bound=None, upper_bound=None, num_partitions: int | None = None,
               properties: dict | None = None, fetch_size: int = 10000) -> DataFrame:
    """A whole remote table, split into ``num_partitions`` parallel range scans by a whole-number
    column.  By default (``"key"``) that is the table's primary key if it is one such column; without one, and with
    ``partition_column=None``, the table comes through one connection.  Bounds default to the
    column's min/max fetched with one tiny remote aggregate."""
    r = _reader(spark, url, properties).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column == "key":
        columns, key = _catalogue(spark, url, table, properties)
        splits = {c[0] for c in columns if c[4] in _WHOLE and not c[5]}
        partition_column = key[0] if len(key) == 1 and key[0] in splits else None
    if partition_column:
        if lower_bound is None or upper_bound is None:
            b = read_query(spark, url, f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                                       f"FROM {table}", properties=properties).first()
            lower_bound, upper_bound = b[0], b[1]
        if lower_bound is None:  # empty table
            return r.load()
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
              .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    return r.load()


def read_query(spark: SparkSession, url: str, sql: str, prepare_query: str | None = None,
               properties: dict | None = None) -> DataFrame:
    """Any SELECT run by the remote database.  A trailing ``;`` is removed
    (Spark wraps the text as a subquery); a leading CTE goes in ``prepare_query``."""
    text = sql.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    r = _reader(spark, url, properties).option("query", text)
    if prepare_query:
        r = r.option("prepareQuery", prepare_query)
    return r.load()


_LIST_TABLES = {
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%'",
    "mysql": "SELECT table_name AS table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "postgresql": "SELECT table_name AS table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "derby": "SELECT t.tablename AS table_name FROM sys.systables t JOIN sys.sysschemas s "
             "ON t.schemaid = s.schemaid WHERE t.tabletype = 'T' AND s.schemaname = CURRENT SCHEMA",
    "h2": "SELECT table_name AS table_name FROM information_schema.tables WHERE table_schema = SCHEMA()",
}


def list_tables(spark: SparkSession, url: str | None = None, properties: dict | None = None) -> DataFrame:
    """Table names, sorted.  Without ``url`` the session's temp views are listed."""
    if url is None:
        names = sorted(t.name for t in spark.catalog.listTables())
        return spark.createDataFrame([(n,) for n in names], "table_name string")
    sql = _LIST_TABLES.get(_dialect(url), _LIST_TABLES["postgresql"])
    df = read_query(spark, url, sql, properties=properties)
    return df.select(F.col(df.columns[0]).cast("string").alias("table_name")).orderBy("table_name")


def table_schema(spark: SparkSession, url: str | None, table: str, properties: dict | None = None) -> DataFrame:
    """Column, type, nullable, key (``PRI`` or empty), default, in the table's order, from the driver's catalogue on every
    dialect.  Without ``url``: a registered view."""
    if url is None:
        fields = spark.table(table).schema.fields
        return spark.createDataFrame(
            [(f.name, f.dataType.simpleString(), f.nullable, None, None) for f in fields],
            "column string, type string, nullable boolean, key string, default string")
    columns, key = _catalogue(spark, url, table, properties)
    if not columns:
        raise ValueError(f"no table '{table}' at {url}")
    return spark.createDataFrame([(n, t, nullable, "PRI" if n in key else "", default) for n, t, nullable, default, *_ in columns],
                                 "column string, type string, nullable boolean, key string, default string")


def load_many(spark: SparkSession, registry, url: str, tables="all", properties: dict | None = None) -> list[str]:
    """Register each remote table lazily as ``sql_<table>``; returns the keys.  Tables with a whole-number key are
    read in ranges of it (S5)."""
    if tables == "all":
        tables = [r["table_name"] for r in list_tables(spark, url, properties).collect()]
    keys = []
    for t in tables:
        df = read_table(spark, url, t, properties=properties)
        keys.append(registry.register(df, name=f"sql_{t}"))
    return keys
