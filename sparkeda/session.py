"""Session helpers: building a session, the shared checkpoint folder, table reads."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "sparkeda", master: str | None = None,
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Return the active session, or build one tuned for analytics work.

    On a cluster the session normally already exists (spark-submit); then its
    configuration is left untouched.  For local runs AQE, Arrow and a UTC
    session zone are switched on and the UI stays off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    defaults.update(conf)
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster sets it; where it is unset a local session gets a scratch folder, so lineage
    cuts still work, and any other session an error: no local folder is shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="sparkeda-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables as temp views under their own names."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def spread(df: DataFrame, partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """Round-robin repartition before CPU-heavy row-local work, for inputs of few files.

    ``partitions`` defaults to twice the cores; an input of that many files or more is returned
    as it is.  Only the file list is looked at, and rows and results are the same either way.  With ``rows``, for work whose time or
    memory goes with a task's rows, there are at least so many partitions that none holds more; this counts the
    rows of a table's files, which are in their footers."""
    target = partitions or df.sparkSession.sparkContext.defaultParallelism * 2
    if df.isStreaming:
        return df
    if rows:
        target = max(target, -(-df.count() // rows))
    return df if len(df.inputFiles()) >= target else df.repartition(target)


def ship_package(spark: SparkSession) -> str:
    """Make this package importable on executors (Python workers unpickle the
    operators' functions, e.g. the HTML parser and Arrow helpers).

    Zips the installed package on the driver and registers it with
    ``addPyFile``; Spark copies it to every executor.  Not needed when the
    package is installed on the cluster image or passed with ``--py-files``."""
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sparkeda-pkg-")
    zpath = os.path.join(out_dir, "sparkeda.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    spark.sparkContext.addPyFile(zpath)
    return zpath


_SHIPPED: set = set()


def ensure_shipped(spark: SparkSession) -> None:
    """``ship_package`` once per SparkContext (harmless when already importable)."""
    key = spark.sparkContext.applicationId
    if key not in _SHIPPED:
        ship_package(spark)
        _SHIPPED.add(key)
