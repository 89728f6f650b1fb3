"""Running values per key without a key in one task.

A window per key sorts a whole key in one task.  Here the rows are range-partitioned by key and order, so a key
that holds a third of the rows lies in many chunks; each chunk runs on its own, the chunks' totals are
added up in order, and what earlier chunks hold is joined to the later ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkeda.session import checkpoint_dir

#: What ``running`` gives: kind -> how a chunk's own value and that of the chunks before it combine.
KINDS = ("sum", "count", "min", "max", "lag", "row_number", "rank")


def running(df: DataFrame, keys: list[str], order: list, columns: dict, partitions: int | None = None) -> DataFrame:
    """``df`` with a column per entry ``name: (kind, column)`` over all rows of the key up to the row itself.

    Kinds: ``sum``, ``count``, ``min``, ``max`` of a column, its value in the row before (``lag``), ``row_number`` and ``rank``
    (no column).  Without keys the whole table is one group.  Null keys are a key.  Rows that agree
    in ``order`` stay in an arbitrary, repeatable order; for ``rank`` they lie in one chunk.

    Only a key's chunks after its first need what came before; a chunk continues one key at the most, so
    that table has no more rows than there are partitions and is broadcast.  The chunks are written by a checkpoint,
    so that both passes over them see the same rows."""
    wrong = [k for k, _ in columns.values() if k not in KINDS]
    if wrong:
        raise ValueError(f"kinds are {', '.join(KINDS)}; got {wrong}")
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranks = any(k == "rank" for k, _ in columns.values())
    tie = [] if ranks else [F.col("_row")]
    by = [F.col(f"`{k}`") for k in keys]
    d = df.withColumn("_row", F.monotonically_increasing_id())
    d = d.repartitionByRange(n, *by, *order, *tie).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)

    w = Window.partitionBy("_part", *by).orderBy(*order, *tie)
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

    def chunk(kind: str, col) -> Column:
        if kind in own:
            return own[kind](col).over(rows)
        return F.lag(col).over(w) if kind == "lag" else (F.rank() if kind == "rank" else F.row_number()).over(w)

    d = d.withColumns({"_at": F.row_number().over(w), **{n_: chunk(k, c) for n_, (k, c) in columns.items()}})
    totals = d.groupBy("_part", *by).agg(*[
        (own[k](c) if k in own else F.max_by(F.struct(F.col(c).alias("v")), "_at") if k == "lag" else F.count("*")).alias(f"_t{i}")
        for i, (k, c) in enumerate(columns.values())], F.count("*").alias("_n"))
    # the chunks of one key: as many rows as it has chunks
    along = Window.partitionBy(*by, F.lit(0)).orderBy("_part")
    past = along.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(i: int, kind: str) -> Column:
        t = F.col(f"_t{i}")
        if kind in ("min", "max"):
            return own[kind](t).over(past)
        return F.lag(t).over(along) if kind == "lag" else F.sum(t).over(past)

    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    offsets = totals.select("_part", *[F.col(f"`{k}`").alias(a) for k, a in names.items()], F.sum("_n").over(past).alias("_before"),
                            *[earlier(i, k).alias(f"_o{i}") for i, (k, _) in enumerate(columns.values())]).where("_before IS NOT NULL")
    offsets = offsets.withColumnRenamed("_part", "_p")
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(a)) for k, a in names.items()], F.col("_part") == F.col("_p"))
    d = d.join(F.broadcast(offsets), on, "left")

    def whole(i: int, name: str, kind: str) -> Column:
        mine, off = F.col(f"`{name}`"), F.col(f"_o{i}")
        if kind == "lag":
            return F.when((F.col("_at") == 1) & F.col("_before").isNotNull(), off["v"]).otherwise(mine)
        if kind in ("min", "max"):
            return (F.least if kind == "min" else F.greatest)(mine, off)
        return F.coalesce(mine + off, mine, off)

    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns],
                    *[whole(i, name, k).alias(name) for i, (name, (k, _)) in enumerate(columns.items())])


def numbered(values: DataFrame, col: str, out: str) -> DataFrame:
    """Different values of a column with their place (from 0) in sorted order: a dictionary that never leaves the cluster."""
    d = running(values.select(F.col(f"`{col}`").alias("value")).where("value IS NOT NULL").distinct(), [], ["value"], {out: ("row_number", None)})
    return d.select("value", (F.col(out) - 1).cast("long").alias(out))


def bounded(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """``table``, marked to be broadcast if it has at most so many rows; else joins are left to the planner."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
