"""Profiles, aggregations and rankings.

Rules kept throughout:
* per-column work is one multi-aggregate pass (or one unpivot + group), never
  a job per column;
* only bounded results (a few rows per column) reach the driver;
* exact quantiles never gather a column into one task: they are found by
  histogram narrowing (a handful of distributed passes), see ``exact_quantiles``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# --------------------------------------------------------------------------- A5
def numeric_columns(df: DataFrame) -> list[str]:
    """A5: numeric columns (bool is not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    """A5: text / category columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null: a missing number is missing however it is written."""
    c = _q(name)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c


def _long_strings(df: DataFrame, cols: list[str], keep_nulls: bool = True) -> DataFrame:
    """Unpivot ``cols`` into (column, value string).  One row per cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), present(df, c).cast("string").alias("value"))
                                for c in cols])).alias("cell")
    out = df.select(cells).select("cell.column_name", "cell.value")
    return out if keep_nulls else out.where(F.col("value").isNotNull())


def _long_doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot numeric ``cols`` into (column, x double), nulls dropped."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("double").alias("x"))
                                for c in cols])).alias("cell")
    return df.select(cells).select("cell.column_name", "cell.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


# ------------------------------------------------------------ exact quantiles
def _order_stat_plan(n: int, probs):
    """For each probability the two 0-based order statistics to interpolate."""
    out = []
    for p in probs:
        pos = (n - 1) * p
        out.append((p, pos, int(math.floor(pos)), int(math.ceil(pos))))
    return out


def _walk(pieces, want):
    """Find the entry holding 0-based rank ``want`` in ordered (count, payload) pieces."""
    acc = 0
    for cnt, payload in pieces:
        if acc + cnt > want:
            return acc, cnt, payload
        acc += cnt
    return None


def column_stats(df: DataFrame, cols: list[str], moments: bool = False) -> dict:
    """One wide, code-generated aggregate per table: per column the count of
    non-null non-NaN values, finite min/max, counts of -inf / +inf and, with
    ``moments``, mean, sample std and raw min/max."""
    inf = float("inf")
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        x = F.when(~F.isnan(x), x)
        fin = F.when((x > -inf) & (x < inf), x)
        aggs += [F.count(x).alias(f"n{i}"), F.min(fin).alias(f"lo{i}"), F.max(fin).alias(f"hi{i}"),
                 F.count_if(x == -inf).alias(f"ng{i}"), F.count_if(x == inf).alias(f"ps{i}")]
        if moments:
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"rmin{i}"), F.max(x).alias(f"rmax{i}")]
    one = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        d = {"n": one[f"n{i}"], "lo": one[f"lo{i}"], "hi": one[f"hi{i}"], "neg": one[f"ng{i}"], "pos": one[f"ps{i}"]}
        if moments:
            d.update(mean=one[f"mean{i}"], std=one[f"std{i}"], min=one[f"rmin{i}"], max=one[f"rmax{i}"])
        out[c] = d
    return out


def _in_intervals(df: DataFrame, intervals: dict[str, list], bins: int) -> DataFrame:
    """Cells that lie in one of their column's intervals, with its number and the bin: ``column_name, x, iid, bin``.

    Each value meets only its own column's bounds, before the columns are unpivoted; null, NaN
    and infinite values lie in no interval."""
    cells = []
    for n, (c, ivs) in enumerate(intervals.items()):
        x, place = F.col(f"c{n}"), F.lit(None).cast("struct<iid:int,bin:int>")
        for i, (lo, hi) in enumerate(ivs):
            share = (x - F.lit(lo)) / (F.lit(hi) - F.lit(lo))
            bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
            place = F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.struct(F.lit(i).alias("iid"), bin_.alias("bin"))).otherwise(place)
        cells.append(F.struct(F.lit(c).alias("column_name"), x.alias("x"), place.alias("at")))
    d = df.select(*[_q(c).cast("double").alias(f"c{n}") for n, c in enumerate(intervals)])
    return (d.select(F.explode(F.array(*cells)).alias("cell")).where(F.col("cell.at").isNotNull())
            .select("cell.column_name", "cell.x", "cell.at.iid", "cell.at.bin"))


def exact_quantiles(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75), bins: int = 1024,
                    final_rows: int = 10_000, stats: dict | None = None) -> dict:
    """Exact quantiles (linear interpolation, as ``percentile`` / numpy) for many columns.

    No task ever holds a whole column, and every pass is one distributed
    group-by whose result is bounded:

    1. ``column_stats`` (one wide aggregate; pass ``stats`` to reuse it);
    2. narrowing passes: one group-by of (column, interval, bin) counts with
       the bin's min/max; the interval holding each wanted rank shrinks to the
       actual min/max of its bin (~``bins``-fold per pass);
    3. once an interval holds at most ``final_rows`` values they are grouped
       by value and read exactly.

    Ranks that fall on -inf / +inf resolve from the counts; narrowing runs on
    finite values only, so it always terminates.  Typical data needs the
    stats pass, one histogram pass and the final read (the histogram pass is
    skipped when a column has at most ``final_rows`` values).
    Returns ``{column: {p: value}}``.
    """
    if not cols:
        return {}
    inf = float("inf")
    stats = stats if stats is not None else column_stats(df, cols)
    result = {c: {p: None for p in probs} for c in cols}
    plans, need = {}, {}
    for c in cols:
        r = stats.get(c)
        if r is None or not r["n"]:
            continue
        n, lo, hi, neg, pos_inf = r["n"], r["lo"], r["hi"], r["neg"], r["pos"]
        plans[c] = _order_stat_plan(n, probs)
        nf = n - neg - pos_inf
        for _, _, k0, k1 in plans[c]:
            for k in (k0, k1):
                # state: [lo, hi, below, resolved, rows in interval]
                if k < neg:
                    need[(c, k)] = [None, None, 0, -inf, 0]
                elif k >= n - pos_inf:
                    need[(c, k)] = [None, None, 0, inf, 0]
                else:
                    need[(c, k)] = [lo, hi, neg, lo if lo == hi else None, nf]

    # narrowing passes, then the final read --------------------------------------
    pending = {key: st for key, st in need.items() if st[3] is None}
    while pending:
        for key, st in pending.items():
            if st[0] == st[1]:
                st[3] = st[0]
        pending = {key: st for key, st in pending.items() if st[3] is None}
        if not pending:
            break
        intervals: dict[str, list] = {}
        all_small = all(st[4] <= final_rows for st in pending.values())
        for (c, _), st in pending.items():
            iv = (st[0], st[1])
            lst = intervals.setdefault(c, [])
            if iv not in lst:
                lst.append(iv)
        tagged = _in_intervals(df, intervals, bins)
        counts = [] if all_small else (
            tagged.groupBy("column_name", "iid", "bin")
            .agg(F.count("*").alias("cnt"), F.min("x").alias("bmin"), F.max("x").alias("bmax"))
            .collect())
        per_iv: dict[tuple, list] = {}
        for r in counts:
            per_iv.setdefault((r["column_name"], r["iid"]), []).append((r["bin"], r["cnt"], r["bmin"], r["bmax"]))
        small_ivs = []
        for (c, k), st in pending.items():
            i = intervals[c].index((st[0], st[1]))
            blist = sorted(per_iv.get((c, i), []))
            total = st[4] if all_small else sum(b[1] for b in blist)
            if total <= final_rows:
                small_ivs.append(((c, k), i))
                continue
            hit = _walk([(b[1], b) for b in blist], k - st[2])
            if hit is not None:
                acc, cnt, b = hit
                st[0], st[1], st[2], st[4] = b[2], b[3], st[2] + acc, cnt
        if small_ivs:
            wanted = {}
            for (c, k), i in small_ivs:
                wanted.setdefault(c, set()).add(i)
            cond = reduce(lambda a, b: a | b,
                          [(F.col("column_name") == c) & F.col("iid").isin(sorted(ids)) for c, ids in wanted.items()])
            vals = tagged.where(cond).groupBy("column_name", "iid", "x").agg(F.count("*").alias("cnt")).collect()
            per = {}
            for r in vals:
                per.setdefault((r["column_name"], r["iid"]), []).append((r["x"], r["cnt"]))
            for (c, k), i in small_ivs:
                st = pending[(c, k)]
                hit = _walk([(cnt, x) for x, cnt in sorted(per.get((c, i), []))], k - st[2])
                if hit is not None:
                    st[3] = hit[2]
        pending = {key: st for key, st in pending.items() if st[3] is None}
    for c, plan in plans.items():
        for p, pos, k0, k1 in plan:
            v0, v1 = need[(c, k0)][3], need[(c, k1)][3]
            if k0 == k1 or v0 == v1:
                result[c][p] = v0
            else:
                result[c][p] = (k1 - pos) * v0 + (pos - k0) * v1
    return result


def median_of(df: DataFrame, col: str, exact: bool = True) -> float | None:
    if exact:
        return exact_quantiles(df, [col], (0.5,))[col][0.5]
    return df.select(F.percentile_approx(_q(col).cast("double"), 0.5, 10000)).first()[0]


# --------------------------------------------------------------------------- A1
DESCRIBE_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe(df: DataFrame, cols: list[str] | None = None, digits: int | None = None,
             exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """A1: count, mean, std (ddof 1), min, quartiles, max per numeric column.

    Long form, one row per column.  ``exact=False`` uses ``percentile_approx``
    in the same single pass (for very wide or huge tables)."""
    spark = df.sparkSession
    cols = cols or numeric_columns(df)
    schema = ("column_name string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    if not cols:
        return spark.createDataFrame([], schema)
    rows = []
    if exact:
        st = column_stats(df, cols, moments=True)
        qs = exact_quantiles(df, cols, (0.25, 0.5, 0.75), stats=st)
        for c in cols:
            m = st[c]
            rows.append((c, m["n"] or 0, [m["mean"], m["std"], m["min"], qs[c][0.25], qs[c][0.5], qs[c][0.75],
                                          m["max"]]))
    else:
        aggs = []
        for c in cols:
            x = _q(c).cast("double")
            aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                     F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                     F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q")]
        one = df.agg(*aggs).first()
        for c in cols:
            q = one[f"{c}__q"] or [None, None, None]
            rows.append((c, one[f"{c}__count"], [one[f"{c}__mean"], one[f"{c}__std"], one[f"{c}__min"], q[0], q[1],
                                                 q[2], one[f"{c}__max"]]))
    out = []
    for c, n, vals in rows:
        if digits is not None:
            vals = [None if v is None else round(v, digits) for v in vals]
        out.append((c, int(n or 0), *[None if v is None else float(v) for v in vals]))
    return spark.createDataFrame(out, schema)


# -------------------------------------------------------------------------- A1b
def describe_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, unique, top, freq per text column (top: most frequent, ties -> smallest)."""
    cols = cols or text_columns(df)
    g = _long_strings(df, cols, keep_nulls=False).groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("v")))
    return (g.groupBy("column_name")
            .agg(F.sum("cnt").alias("count"), F.count("*").alias("unique"), best.alias("b"))
            .select("column_name", "count", "unique", F.col("b.v").alias("top"), (-F.col("b.neg")).alias("freq")))


# --------------------------------------------------------------------------- A2
def null_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """A2: nulls per column and % of that column, plus a ``(total)`` row with % of all cells."""
    spark = df.sparkSession
    cols = df.columns
    if not cols:
        return spark.createDataFrame([], "column_name string, nulls long, pct double")
    aggs = [F.count("*").alias("__rows")] + [F.count_if(present(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"))
                                for i, c in enumerate(cols)])).alias("s")
    per = one.select("__rows", stack).select("__rows", "s.column_name", "s.nulls")
    pct = F.round(F.try_divide(F.col("nulls") * 100.0, F.col("__rows")), digits)
    total = (one.select(F.lit("(total)").alias("column_name"),
                        reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(cols))]).alias("nulls"),
                        (F.col("__rows") * len(cols)).alias("__rows")))
    return per.select("column_name", "nulls", pct.alias("pct")).unionByName(
        total.select("column_name", "nulls", pct.alias("pct")))


# --------------------------------------------------------------------------- A3
def column_profile(df: DataFrame, approx: bool = False, with_rows: bool = False) -> DataFrame:
    """A3: column, type, nulls, distinct (nulls excluded, like ``nunique``);
    ``with_rows`` adds the table's row count to each row (same pass).

    Unpivot then group: (column, value) pairs are combined map-side, so a
    hot value costs one row per task, and no wide ``Expand`` is built."""
    fields = df.schema.fields
    types = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    # only a digest of a text travels: distinct texts are counted, not carried
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), (
        F.unhex(F.sha2(_q(f.name), 256)) if isinstance(f.dataType, T.StringType)
        else present(df, f.name).cast("string").cast("binary")).alias("value")) for f in fields])
    long = df.select(F.explode(cells).alias("cell")).select("cell.column_name", "cell.value")
    if approx:
        out = long.groupBy("column_name").agg(F.count_if(F.col("value").isNull()).alias("nulls"),
                                         F.approx_count_distinct("value").alias("distinct"))
    else:
        g = long.groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
        out = g.groupBy("column_name").agg(F.sum(F.when(F.col("value").isNull(), F.col("cnt")).otherwise(0)).alias("nulls"),
                                      F.count("value").alias("distinct"), F.sum("cnt").alias("rows"))
    cols = [F.col("column_name"), F.element_at(types, F.col("column_name")).alias("type"),
            F.col("nulls").cast("long").alias("nulls"), F.col("distinct").cast("long").alias("distinct")]
    if with_rows and not approx:
        cols.append(F.col("rows").cast("long").alias("rows"))
    return out.select(*cols)


# --------------------------------------------------------------------------- A4
def shape_metrics(df: DataFrame) -> DataFrame:
    """A4: rows, columns, null cells, numeric columns (one row)."""
    cols = df.columns
    nulls = reduce(lambda a, b: a + b, [F.count_if(present(df, c).isNull()) for c in cols], F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls")).select(
        "rows", F.lit(len(cols)).alias("columns"), "nulls", F.lit(len(numeric_columns(df))).alias("numeric_columns"))


# --------------------------------------------------------------------------- A6
def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20, exact_median: bool = True) -> DataFrame:
    """Numpy-style histogram per numeric column plus mean and median marks.

    Edges split [min, max] evenly (a constant column uses [v-0.5, v+0.5]); the
    last bin is closed.  Bin index follows numpy: scaled index, then one-step
    corrections against the exact edges.  Every bin is returned, empty ones
    with count 0.  Output: column_name, bin, lower, upper, count, mean, median.

    Passes: the exact-median passes (whose first pass also yields min, max
    and mean per column), then one aggregate of (column, bin) counts with the
    bounds as literals; the result is at most ``columns x bins`` rows."""
    spark = df.sparkSession
    cols = cols or numeric_columns(df)
    schema = ("column_name string, bin int, lower double, upper double, count long, mean double, median double")
    if not cols:
        return spark.createDataFrame([], schema)
    # infinite values cannot be binned (numpy refuses an infinite range): finite values only
    long = _long_doubles(df, cols).where((F.col("x") > float("-inf")) & (F.col("x") < float("inf")))
    if exact_median:
        cs = column_stats(df, cols, moments=True)
        med = exact_quantiles(df, cols, (0.5,), stats=cs)
        st = {c: {"n": m["n"], "mn": m["lo"], "mx": m["hi"], "mean": m["mean"]} for c, m in cs.items()}
        medians = {c: med[c][0.5] for c in cols}
    else:
        st = {r["column_name"]: r for r in long.groupBy("column_name").agg(
            F.count("x").alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.avg("x").alias("mean"),
            F.percentile_approx("x", 0.5, 10000).alias("m")).collect()}
        medians = {c: r["m"] for c, r in st.items()}
    cols = [c for c in cols if c in st and st[c]["n"] and st[c]["mn"] is not None]
    if not cols:
        return spark.createDataFrame([], schema)
    bounds = {}
    for c in cols:
        mn, mx = st[c]["mn"], st[c]["mx"]
        bounds[c] = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    lo = F.element_at(F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(float(bounds[c][0])))]),
                      F.col("column_name"))
    hi = F.element_at(F.create_map(*[v for c in cols for v in (F.lit(c), F.lit(float(bounds[c][1])))]),
                      F.col("column_name"))
    j = long.select("column_name", "x", lo.alias("lo"), hi.alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    idx0 = F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))).cast("int")
    j = j.select("column_name", "x", "lo", "hi", F.when(idx0 >= bins, bins - 1).otherwise(idx0).alias("i1"))
    j = j.select("column_name", "x", "lo", "hi",
                 F.when(F.col("x") < edge(F.col("i1")), F.col("i1") - 1).otherwise(F.col("i1")).alias("i2"))
    idx3 = F.when((F.col("x") >= edge(F.col("i2") + 1)) & (F.col("i2") != bins - 1), F.col("i2") + 1) \
        .otherwise(F.col("i2"))
    counts = {(r["column_name"], r["bin"]): r["count"] for r in
              j.groupBy("column_name", idx3.alias("bin")).agg(F.count("*").alias("count")).collect()}
    rows = []
    for c in cols:
        a, b = bounds[c]
        w = (b - a) / bins
        for i in range(bins):
            rows.append((c, i, a + i * w, b if i == bins - 1 else a + (i + 1) * w, int(counts.get((c, i), 0)),
                         st[c]["mean"], None if medians.get(c) is None else float(medians[c])))
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- A7
def value_counts(df: DataFrame, cols: list[str] | None = None, top: int = 12) -> DataFrame:
    """The ``top`` most frequent non-null values per column (ties -> smaller value,
    compared as numbers for numeric columns).

    ``row_number() <= top`` is planned as a WindowGroupLimit, so each map task
    forwards at most ``top`` rows per column to the final window."""
    cols = cols or text_columns(df)
    g = _long_strings(df, cols, keep_nulls=False).groupBy("column_name", "value").agg(F.count("*").alias("count"))
    num = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC_TYPES)]
    as_num = F.when(F.col("column_name").isin(num), F.col("value").try_cast("double")) if num \
        else F.lit(None).cast("double")
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), as_num.asc_nulls_last(), F.col("value").asc())
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# --------------------------------------------------------------------------- A8
def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix, pairwise-complete, in one aggregate pass.

    ``covar_pop / (stddev_pop * stddev_pop)`` over the rows where both are
    non-null, with ``try_divide``: NULL for a constant column, where built-in
    ``corr`` raises under ANSI.  Output: col_a, col_b, corr (all ordered pairs)."""
    cols = cols or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("correlation needs at least 2 numeric columns")
    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa, xb = _q(a).cast("double"), _q(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull() & ~F.isnan(xa) & ~F.isnan(xb)
            ya, yb = F.when(both, xa), F.when(both, xb)
            r = F.try_divide(F.covar_pop(ya, yb), F.stddev_pop(ya) * F.stddev_pop(yb))
            name = f"r{len(pairs)}"
            aggs.append(r.alias(name))
            pairs.append((a, b, name))
    one = df.agg(*aggs)
    cells = []
    for a, b, name in pairs:
        cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(name).alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(name).alias("corr")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.col_a", "c.col_b", "c.corr")


# -------------------------------------------------------------------------- A10
def top_by_row_mean(df: DataFrame, id_col: str, score_cols: list[str], n: int = 10) -> DataFrame:
    """A10: coerce scores to numbers, row mean skipping nulls, mean per id, top ``n``
    (ties -> smaller id; ids whose rows are all null sort last)."""
    xs = [_q(c).cast("string").try_cast("double") for c in score_cols]
    s = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    k = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    row_mean = F.try_divide(s, F.when(k > 0, k))
    return (df.select(_q(id_col).alias(id_col), row_mean.alias("row_mean"))
            .groupBy(id_col).agg(F.avg("row_mean").alias("mean_score"))
            .orderBy(F.col("mean_score").desc_nulls_last(), F.col(id_col).asc()).limit(n))


# -------------------------------------------------------------------------- A11
def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``key``, flagged against the mean of the group means.

    The overall mean is a one-row aggregate of the (distributed) group table,
    cross-joined by broadcast: its size is exactly one row."""
    g = df.groupBy(_q(key).alias(key)).agg(F.avg(_q(value).cast("double")).alias("mean"))
    overall = g.agg(F.avg("mean").alias("overall_mean"))
    return (g.crossJoin(F.broadcast(overall))
            .select(key, "mean", "overall_mean", (F.col("mean") >= F.col("overall_mean")).alias("above"))
            .orderBy("mean", key))


# -------------------------------------------------------------------------- A12
def quality_report(records: DataFrame, kind_col: str = "tipo", content_col: str = "contenido") -> DataFrame:
    """Records per kind, empty/null content, duplicate rows, images without src, total.

    Output long form: metric, kind, value."""
    cols = records.columns
    empty = F.col(content_col).isNull() | (F.col(content_col) == "") if content_col in cols else F.lit(False)
    no_src = (F.col(kind_col) == "imagen") & (F.col("src").isNull() | (F.col("src") == "")) if "src" in cols else F.lit(False)
    rows = records.groupBy(*[_q(c) for c in cols]).agg(F.count("*").alias("_n"))
    kinds = rows.groupBy(kind_col).agg(
        F.sum("_n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(empty, F.col("_n")).otherwise(0)).alias("empty"),
        F.sum(F.when(no_src, F.col("_n")).otherwise(0)).alias("no_src"))

    def metric(name: str, value: Column, kind: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("metric"), (F.lit(None) if kind is None else kind).cast("string").alias("kind"), value.cast("long").alias("value"))

    def totals(total: Column, empty: Column, duplicates: Column, no_src: Column) -> list[Column]:
        return [metric("total", total), metric("empty_content", empty), metric("duplicates", duplicates), metric("images_without_src", no_src)]

    # each kind adds its part to the totals, so the records are grouped once; no records at all have totals of 0
    parts = kinds.select(F.explode(F.array(*totals(F.col("total"), F.col("empty"), F.col("total") - F.col("distinct"), F.col("no_src")),
                                           metric("records_per_kind", F.col("total"), _q(kind_col)))).alias("m")).select("m.*")
    none = records.sparkSession.range(1).select(F.explode(F.array(*totals(*[F.lit(0)] * 4))).alias("m")).select("m.*")
    return parts.unionByName(none).groupBy("metric", "kind").agg(F.sum("value").alias("value"))


# -------------------------------------------------------------------------- A13
def class_counts(df: DataFrame, label: str, check: bool = False) -> DataFrame:
    """Rows per class; with ``check`` raise when fewer than 2 classes exist."""
    out = df.groupBy(_q(label).alias(label)).agg(F.count("*").alias("count"))
    if check:
        n = out.limit(2).count()
        if n < 2:
            raise ValueError(f"column '{label}' has fewer than 2 classes; a classifier needs at least 2")
    return out
