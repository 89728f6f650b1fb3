"""File sources (S1-S4, S9, S12) and sinks (K1, K2)."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkeda.dataset import Dataset

# The text tokens pandas reads as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

SUPPORTED_EXTENSIONS = (".csv", ".tsv", ".txt", ".json", ".parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme and globs)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = fs.globStatus(jpath)
    return statuses is not None and len(statuses) > 0


def _require(spark: SparkSession, path: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such file or directory: {path}")


def normalize_missing(df: DataFrame) -> DataFrame:
    """One projection: NaN -> NULL on floating columns, NA tokens -> NULL on strings."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def _wrap(df: DataFrame, path: str, name: str | None, fmt: str, as_dataset: bool, **meta):
    df = df if fmt in ("csv", "tsv") else normalize_missing(df)
    if not as_dataset:
        return df
    base = name or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return Dataset(name=base, df=df, origin=path, metadata={"format": fmt, **meta})


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become whole numbers, numbers, booleans, dates or timestamps where every
    value that is there reads as one; one aggregate over the table."""
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        v = F.trim(F.col(f"`{c}`"))
        fits = {k: v.try_cast(k).isNotNull() for k in kinds}
        fits["boolean"] = F.lower(v).isin("true", "false")
        fits["date"] = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & v.try_cast("date").isNotNull()
        fits["timestamp"] = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d") & v.try_cast("timestamp").isNotNull()
        aggs += [F.count(v).alias(f"n{i}"), *[F.count_if(fits[k]).alias(f"{k}{i}") for k in kinds]]
    r = df.agg(*aggs).first()
    to = {}
    for i, c in enumerate(texts):
        kind = next((k for k in kinds if r[f"n{i}"] and r[f"{k}{i}"] == r[f"n{i}"]), None)
        if kind:
            to[c] = F.trim(F.col(f"`{c}`")).cast(kind)
    return df.select(*[to.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, name: str | None = None, schema=None,
             sep: str = ",", as_dataset: bool = False, multi_line: bool | None = None, **opts):
    """Header row, UTF-8 (a BOM is dropped by the reader); missing path is an error.

    A quote inside quotes is doubled, and quoted fields may hold line breaks.  Files are read in splits
    unless a field does: then some line has an odd number of quotes, which one pass over all lines
    finds out (``multi_line`` True or False says it beforehand and saves the pass); such files are one task each.  NA tokens are
    missing before types are inferred, so a column of numbers and ``NA`` is one of numbers."""
    _require(spark, path)
    if multi_line is None:
        multi_line = not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("quote", '"')
              .option("escape", '"').option("multiLine", multi_line))
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in opts.items():
        reader = reader.option(k, v)
    df = normalize_missing(reader.csv(path))
    return _wrap(df if schema is not None else infer_types(df), path, name, "csv" if sep == "," else "tsv", as_dataset)


def read_tsv(spark: SparkSession, path: str, name: str | None = None, schema=None,
             as_dataset: bool = False, **opts):
    """Tab separated (``.tsv`` or ``.txt``)."""
    return read_csv(spark, path, name=name, schema=schema, sep="\t", as_dataset=as_dataset, **opts)


def read_json(spark: SparkSession, path: str, name: str | None = None, schema=None,
              multi_line: bool = False, as_dataset: bool = False, **opts):
    """S3: JSON records: one record, or an array of records, per line (the layout that splits).

    ``multi_line=True`` reads files that each are one value over several lines.  The reader does not
    guess: what it cannot read as told is an error."""
    _require(spark, path)
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in opts.items():
        reader = reader.option(k, v)
    return _wrap(reader.json(path), path, name, "json", as_dataset)


def read_parquet(spark: SparkSession, path: str, name: str | None = None, as_dataset: bool = False):
    """Parquet; NaN is missing here as in every source."""
    _require(spark, path)
    df = spark.read.parquet(path)
    if any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        df = df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
                         if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
    if not as_dataset:
        return df
    base = name or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return Dataset(name=base, df=df, origin=path, metadata={"format": "parquet"})


def load(spark: SparkSession, path: str, name: str | None = None, as_dataset: bool = False, **opts):
    """Choose the reader by extension; an unknown extension raises with the valid list."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_csv(spark, path, name=name, as_dataset=as_dataset, **opts)
    if ext in (".tsv", ".txt"):
        return read_tsv(spark, path, name=name, as_dataset=as_dataset, **opts)
    if ext == ".json":
        return read_json(spark, path, name=name, as_dataset=as_dataset, **opts)
    if ext == ".parquet":
        return read_parquet(spark, path, name=name, as_dataset=as_dataset)
    raise ValueError(f"unsupported format '{ext}'; valid formats: {', '.join(SUPPORTED_EXTENSIONS)}")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows; the limit is pushed to the scan (no full read)."""
    return df.limit(n)


PAGE_COLUMNS = ("page_id", "url", "html")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages ``(page_id, url, html)`` from parquet (or JSON lines)."""
    df = load(spark, path) if not path.rstrip("/").endswith(".parquet") else read_parquet(spark, path)
    missing = [c for c in PAGE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"pages table lacks columns {missing}")
    return df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists",
         partition_by: list[str] | None = None) -> str:
    """K1: write csv (header), tsv/txt (tab, header), json (lines) or parquet.

    The format comes from ``fmt`` or the path's extension; unknown -> csv.
    Spark writes a folder of part files, one per partition, with no BOM.  What is there already is an error unless ``mode`` says
    otherwise; overwriting the files that ``df`` still has to be read from is always one.
    """
    if mode == "overwrite":
        target = path.rstrip("/").split(":", 1)[-1].lstrip("/")
        if any(f"{f.split(':', 1)[-1].lstrip('/')}/".startswith(f"{target}/") for f in df.inputFiles()):
            raise ValueError(f"{path} is what the rows are read from; write them elsewhere first")
    fmt = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt in ("tsv", "txt"):
        w.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    elif fmt == "json":
        w.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("escape", '"').csv(path)
    return path


RUN_METADATA_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("status_http", T.IntegerType()),
    T.StructField("scrape_type", T.StringType()),
    T.StructField("response_time", T.StringType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("kinds", T.ArrayType(T.StringType())),
    T.StructField("exported_at", T.StringType()),
])


def write_run_metadata(spark: SparkSession, path: str, url: str, status_code: int, scrape_type: str,
                       response_time: float, record_count: int, kinds: list[str],
                       scraped_at: _dt.datetime | None = None) -> DataFrame:
    """K2: append one metadata row for an extraction run to a JSON table."""
    now = _dt.datetime.now()
    row = (url, (scraped_at or now).strftime("%Y-%m-%d %H:%M:%S"), int(status_code), scrape_type,
           f"{response_time}s", int(record_count), list(kinds), now.strftime("%Y-%m-%d %H:%M:%S"))
    df = spark.createDataFrame([row], RUN_METADATA_SCHEMA)
    df.coalesce(1).write.mode("append").json(path)
    return df
