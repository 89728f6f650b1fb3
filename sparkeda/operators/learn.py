"""Learning operators (M1-M22, U2) on ``pyspark.ml``.

Feature preparation and metrics are DataFrame expressions; models are
``pyspark.ml`` estimators (each tree level / optimizer step is a distributed
job).  Only model parameters, class lists and small metric tables reach the
driver.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkeda.dataset import Dataset, DatasetSplit
from sparkeda.operators.clustering import fit_starts
from sparkeda.operators.ordered import bounded, numbered, running
from sparkeda.operators.profile import NUMERIC_TYPES, column_profile, numeric_columns, present

ID_NAMES = ("id", "nombre", "name", "index")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ M1-M4
def candidate_targets(df: DataFrame, profile: list | None = None) -> DataFrame:
    """M1: columns whose distinct count is <= max(20, 10 % of rows); all columns when
    none qualifies.  One profile pass; the result has one row per column.
    Output: column_name, distinct, candidate."""
    prof = profile if profile is not None else column_profile(df, with_rows=True).collect()
    rows = max((r["rows"] for r in prof), default=0)
    limit = max(20, rows * 0.1)
    ok = {r["column_name"]: r["distinct"] <= limit for r in prof}
    any_ok = any(ok.values())
    order = {f.name: i for i, f in enumerate(df.schema.fields)}
    out = [(r["column_name"], r["distinct"], ok[r["column_name"]] if any_ok else True)
           for r in sorted(prof, key=lambda r: order.get(r["column_name"], 0))]
    return df.sparkSession.createDataFrame(out, "column_name string, distinct long, candidate boolean")


def encode_label(df: DataFrame, col: str, out: str = "label") -> tuple[DataFrame, DataFrame]:
    """M2: classes -> 0..k-1 in sorted order, whatever the classes are; returns the frame and the table of the
    classes (``label, value``), which maps predictions back.

    A null text is a class of its own (``"nan"``), a whole number of any size or sign is a class;
    rows whose numeric label is missing have nothing to learn from and are dropped.  The classes are numbered by range
    partitions and joined back (broadcast up to a checked number of rows); no list of them reaches the driver."""
    numeric = isinstance(df.schema[col].dataType, NUMERIC_TYPES)
    key = _q(col).cast("double") if numeric else F.coalesce(_q(col).cast("string"), F.lit("nan"))
    if numeric:
        key = F.when(~F.isnan(key), key + F.lit(0.0))
    d = df.withColumn("_label_key", key)
    codes = numbered(d.select("_label_key"), "_label_key", out)
    codes = codes.select(F.col("value").alias("_value"), F.col(out).cast("double").alias(out))
    d = d.drop(out) if out in df.columns and out != col else d
    kept = [c for c in d.columns if c not in ("_label_key", out)]
    coded = d.join(bounded(codes).withColumnRenamed(out, "_code"), F.col("_label_key") == F.col("_value")).select(
        *[_q(c) for c in kept], F.col("_code").alias(out))
    return coded, codes.select(F.col(out).alias("label"), F.col("_value").alias("value"))


def usable_features(df: DataFrame, target: str, exclude=(), profile: list | None = None) -> DataFrame:
    """M3: which columns can feed a classifier (one profile pass).

    Output: column_name, role (numeric | categorical | excluded), reason."""
    rows_ = profile if profile is not None else column_profile(df, with_rows=True).collect()
    prof = {r["column_name"]: r for r in rows_}
    rows = max((r["rows"] for r in rows_), default=0)
    limit = max(20, rows * 0.1)
    out = []
    for f in df.schema.fields:
        c = f.name
        if c == target:
            continue
        if c in exclude:
            out.append((c, "excluded", "user"))
        elif isinstance(f.dataType, T.StringType):
            if prof[c]["distinct"] > limit:
                out.append((c, "excluded", "too many values"))
            elif c.lower() in ID_NAMES:
                out.append((c, "excluded", "identifier name"))
            else:
                out.append((c, "categorical", ""))
        elif isinstance(f.dataType, NUMERIC_TYPES):
            out.append((c, "excluded", "has nulls") if prof[c]["nulls"] > 0 else (c, "numeric", ""))
        else:
            out.append((c, "excluded", "type"))
    return df.sparkSession.createDataFrame(out, "column_name string, role string, reason string")


def _categories(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """The sorted non-null values of each column, in one pass: what becomes a column each."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _q(c).cast("string").alias("v")) for c in cols])).alias("x")
    values: dict[str, list] = {c: [] for c in cols}
    for r in df.select(cells).select("x.c", "x.v").where("v IS NOT NULL").distinct().collect():
        values[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in values.items()}


def one_hot(df: DataFrame, cols: list[str], sep: str = "_") -> tuple[DataFrame, list[str]]:
    """M4: 0/1 columns per category, the alphabetically first dropped; a null row is
    all zeros.  Every category counts; M3's rule is the only filter on columns.
    Returns the frame and the new column names."""
    if not cols:
        return df, []
    new = {f"{c}{sep}{v}": F.coalesce((_q(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
           for c, vs in _categories(df, cols).items() for v in vs[1:]}
    return (df.withColumns(new) if new else df), list(new)


def one_hot_vectors(df: DataFrame, cols: list[str], sep: str = "_") -> tuple[DataFrame, list[str], DataFrame]:
    """M4 for models: one sparse vector column per category column, however many categories it has.

    The alphabetically first category and null are the zero vector.  Categories are numbered by range partitions and joined back, so
    none of them reaches the driver.  Returns the frame, the vector columns, and the table of their places
    (``vector, place, name``)."""
    vectors, names = [], df.sparkSession.createDataFrame([], "vector string, place long, name string")
    for k, c in enumerate(cols):
        text = df.select(_q(c).cast("string").alias("v"))
        codes = numbered(text, "v", "code")
        size = codes.count() - 1
        if size < 1:
            continue
        index, vec = f"_index{k}", f"_hot{k}"
        coded = bounded(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
        # the first category and null get the last index, which the encoder drops; it knows their number from the column's attribute
        place = F.when(F.col("_code") > 0, F.col("_code") - 1).otherwise(F.lit(size)).cast("double")
        attribute = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
        df = df.join(coded, _q(c).cast("string") == F.col("_value"), "left").withColumn(index, place.alias(index)).drop("_value", "_code")
        df = df.withMetadata(index, attribute)
        df = OneHotEncoder(inputCol=index, outputCol=vec, dropLast=True).fit(df).transform(df).drop(index)
        vectors.append(vec)
        names = names.unionByName(codes.where("code > 0").select(
            F.lit(vec).alias("vector"), (F.col("code") - 1).alias("place"), F.concat(F.lit(f"{c}{sep}"), F.col("value")).alias("name")))
    return df, vectors, names


# ------------------------------------------------------------------ M5, M6
def _hash01(cols, seed: int) -> Column:
    """A number in [0, 1) from the md5 of the columns and the seed, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(_q(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def split(df, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None):
    """M5: repeatable train/test split by a hash of ``key`` (all columns by default):
    no shuffle, and stable when the input order changes (``randomSplit`` is not)."""
    ds = df if isinstance(df, Dataset) else None
    d = ds.df if ds else df
    u = _hash01(key or d.columns, seed)
    train, test = d.where(u >= test_size), d.where(u < test_size)
    if ds:
        return DatasetSplit(ds.with_df(train, name=f"{ds.name}_train"), ds.with_df(test, name=f"{ds.name}_test"))
    return train, test


def stratified_split(df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, key: list[str] | None = None,
                     exact: bool = False, bins: int = 4096):
    """M6: split keeping each class's share, within sampling error, by a hash that is
    salted with the class: no shuffle, no threshold to look up.  Only when every class has
    2 rows or more (otherwise a plain split, as the reference does).

    With ``exact`` every class gives its share of rows to the test part, rounded half up: the rows of least hash.  Rows
    are counted per class and hash range; below and above the one range that holds the last test row the range decides, and only
    the rows in it are numbered, in chunks, so no class goes through one task.  Null labels are a class."""
    least = df.groupBy(_q(label)).count().agg(F.min("count")).first()[0]
    if least is None or least < 2:
        return split(df, test_size, seed, key)
    u = _hash01([*(key or [c for c in df.columns if c != label]), label], seed)
    if not exact:
        return df.where(u >= test_size), df.where(u < test_size)
    cell = F.floor(u * bins).cast("int")
    counts = df.groupBy(_q(label).alias("_class"), cell.alias("_cell")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("_class")  # one row per range: at most ``bins`` a class
    upto = by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.select("_class", "_cell", "n", F.sum("n").over(upto).alias("upto"),
                          F.floor(F.sum("n").over(by) * test_size + 0.5).alias("take"))
    last = sized.where("take > upto - n AND take <= upto").select("_class", F.col("_cell").alias("_last"), (F.col("take") - F.col("upto") + F.col("n")).alias("_need"))
    d = df.withColumns({"_u": u, "_cell": cell}).join(bounded(last), _q(label).eqNullSafe(F.col("_class")), "left")
    d = d.withColumn("_last", F.coalesce("_last", F.lit(-1)))  # a share that rounds to nothing takes no range
    deciding = running(d.where("_cell = _last"), [label], ["_u"], {"_at": ("row_number", None)})
    parts = []
    for clear, within in (("_cell > _last", "_at > _need"), ("_cell < _last", "_at <= _need")):
        parts.append(d.where(clear).select(*[_q(c) for c in df.columns]).unionByName(deciding.where(within).select(*[_q(c) for c in df.columns])))
    return tuple(parts)


# ------------------------------------------------------------------ features
def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """One vector column from numeric and vector columns; dots in names are no path here."""
    safe = {f"_in{i}": _q(c) for i, c in enumerate(cols)}
    d = df.withColumns(safe)
    return VectorAssembler(inputCols=list(safe), outputCol=out, handleInvalid="keep").transform(d).drop(*safe)


def prepare_classification(df: DataFrame, target: str, exclude=(), key: list[str] | None = None):
    """M2 + M3 + M4 + assembly: (frame with features, label and the ``key`` columns, table of the feature
    ``place`` and ``name``, table of the classes)."""
    prof = column_profile(df, with_rows=True).collect()
    skip = [*exclude, *(key or [])]
    roles = {r["column_name"]: r["role"] for r in usable_features(df, target, skip, profile=prof).collect()}
    num = [c for c, r in roles.items() if r == "numeric"]
    cat = [c for c, r in roles.items() if r == "categorical"]
    d, classes = encode_label(df, target)
    d, vectors, names = one_hot_vectors(d, cat)
    if not num and not vectors:
        raise ValueError("no usable input columns to train on")
    d = assemble(d, num + vectors)
    # places: the numbers first, then the vectors one after another
    sizes = {r["vector"]: r["n"] for r in names.groupBy("vector").agg(F.count("*").alias("n")).collect()}  # one row per column
    at, first = len(num), {}
    for v in vectors:
        first[v], at = at, at + sizes[v]
    table = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(num)], "place long, name string")
    for v in vectors:
        table = table.unionByName(names.where(F.col("vector") == v).select((F.col("place") + first[v]).alias("place"), "name"))
    return d.select("features", "label", *[_q(c) for c in key or []]), table, classes


# ------------------------------------------------------------------ M7-M9, U2
def decision_tree(max_depth: int = 5, seed: int = 42, max_bins: int = 32) -> Estimator:
    """M7."""
    return DecisionTreeClassifier(maxDepth=max_depth, impurity="gini", seed=seed, maxBins=max_bins)


def logistic_regression(n_train: int, max_iter: int = 1000, C: float = 1.0) -> Estimator:
    """M8: L2 with the same strength as C=1 in the reference's library
    (``regParam = 1 / (C * n)``), no standardization."""
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / (C * max(n_train, 1)), elasticNetParam=0.0,
                              standardization=False)


def random_forest(n_trees: int = 100, max_depth: int = 5, seed: int = 42) -> Estimator:
    """M9."""
    return RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed)


class Model(ABC):
    """A user model with ``train`` / ``predict``."""

    kind = "supervised"
    task = "classification"

    @abstractmethod
    def train(self, df: DataFrame) -> "Model":
        ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame:
        ...


class SparkModel(Model):
    """U2 adapter for any ``pyspark.ml`` estimator (features / label columns)."""

    def __init__(self, estimator: Estimator, name: str | None = None):
        self.estimator = estimator
        self.name = name or type(estimator).__name__
        self.fitted = None

    def train(self, df):
        self.fitted = self.estimator.fit(df)
        return self

    def predict(self, df):
        return self.fitted.transform(df)


class SupervisedModel(SparkModel):
    kind = "supervised"


class UnsupervisedModel(SparkModel):
    kind = "unsupervised"
    task = "clustering"


# ------------------------------------------------------------------ M10-M15
def _conf(pred: DataFrame, label: str, prediction: str, by=()) -> DataFrame:
    return pred.groupBy(*by, _q(label).cast("string").alias("y"), _q(prediction).cast("string").alias("p")) \
        .agg(F.count("*").alias("n"))


def _per_class(conf: DataFrame, by=()) -> DataFrame:
    """tp, support, predicted per class, over the union of true and predicted classes."""
    a = conf.groupBy(*by, F.col("y").alias("cls")).agg(F.sum("n").alias("support"),
                                                       F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    b = conf.groupBy(*by, F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = a.join(b, [*by, "cls"], "full")
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select(*by, "cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("predicted", F.lit(0)).alias("predicted"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           by=(), digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 on zero division)."""
    pc = _per_class(_conf(pred, label, prediction, by), by)
    m = pc.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    return m.select(*by, *[F.round(F.try_divide(F.col(a).cast("double"), F.col("n")), digits).alias(b)
                           for a, b in (("tp", "accuracy"), ("wp", "precision"), ("wr", "recall"), ("wf", "f1"))])


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """Precision, recall, F1, support per class; an ``accuracy`` row (F1 column,
    support = all rows); macro and weighted averages."""
    pc = _per_class(_conf(pred, label, prediction))  # one row per class
    per = pc.select(F.col("cls").alias("class"), "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    tot = pc.agg(F.sum("support").alias("n"), F.count("*").alias("k"), F.sum("tp").alias("tp_all"),
                 F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"), F.sum(F.col("f1") * F.col("support")).alias("wf"))
    macro = tot.select(F.lit("macro avg").alias("class"), (F.col("sp") / F.col("k")).alias("precision"),
                       (F.col("sr") / F.col("k")).alias("recall"), (F.col("sf") / F.col("k")).alias("f1"),
                       F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.try_divide(F.col("wp"), F.col("n")).alias("precision"),
                          F.try_divide(F.col("wr"), F.col("n")).alias("recall"),
                          F.try_divide(F.col("wf"), F.col("n")).alias("f1"), F.col("n").cast("long").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.try_divide(F.col("tp_all").cast("double"), F.col("n")).alias("f1"),
                     F.col("n").cast("long").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def best_model(table: DataFrame, metric: str = "f1", model_col: str = "model") -> DataFrame:
    """The model with the highest metric (ties -> smaller name)."""
    return table.agg(F.min(F.struct((-F.col(metric)).alias("neg"), F.col(model_col).alias("m"))).alias("b")) \
        .select(F.col("b.m").alias(model_col), (-F.col("b.neg")).alias(metric))


def confusion(pred: DataFrame, classes: list[str], label: str = "label", prediction: str = "prediction",
              other: str = "(other)") -> DataFrame:
    """Confusion matrix, one row per true class, one column per predicted class; ``other`` counts
    predictions that are none of ``classes``."""
    p = _q(prediction).cast("string")
    known = F.when(p.isin(list(classes)), p).otherwise(F.lit(other))
    columns = [*classes, other]
    return (pred.select(_q(label).cast("string").alias("label"), known.alias("p"))
            .groupBy("label").pivot("p", columns).agg(F.count(F.lit(1))).na.fill(0, subset=columns))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE and R^2 (``1 - SSE/SST``, NULL when SST is 0) over the rows that have both
    numbers, in one pass: SST is the population variance times the rows."""
    d = pred.select(_q(label).cast("double").alias("y"), _q(prediction).cast("double").alias("p")).where(
        "y IS NOT NULL AND p IS NOT NULL AND NOT isnan(y) AND NOT isnan(p)")
    sse = F.sum(F.pow(F.col("y") - F.col("p"), 2))
    return d.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("rmse"),
                 (F.lit(1.0) - F.try_divide(sse, F.var_pop("y") * F.count("y"))).alias("r2"))


def compare_models(train: DataFrame, test: DataFrame, estimators: dict | None = None,
                   digits: int = 4, parallelism: int = 3) -> tuple[DataFrame, dict, list]:
    """Fit each estimator on ``train`` (features/label), score on ``test``.
    Returns (metrics sorted by F1 desc, predictions per model, failures); a model that failed is a row
    of the table too, with its error and without metrics."""
    spark = train.sparkSession
    train = train.persist()
    n = train.count()
    if estimators is None:
        estimators = {"decision_tree": decision_tree(), "logistic_regression": logistic_regression(n),
                      "random_forest": random_forest()}
    from concurrent.futures import ThreadPoolExecutor

    def fit_score(name, est):
        p = est.fit(train).transform(test)
        r = classification_metrics(p, digits=digits).first()
        return p, (name, r["accuracy"], r["precision"], r["recall"], r["f1"], None)

    rows, preds, failures = [], {}, []
    # independent fits: submitted as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(estimators)))) as pool:
        futs = [(name, pool.submit(fit_score, name, est)) for name, est in estimators.items()]
        for name, fut in futs:
            try:
                p, row = fut.result()
                preds[name] = p
                rows.append(row)
            except Exception as e:  # noqa: BLE001 -- a failing model is reported and skipped
                failures.append((name, f"{type(e).__name__}: {e}"))
                rows.append((name, None, None, None, None, failures[-1][1]))
    train.unpersist()
    table = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, error string")
    return table.orderBy(F.col("f1").desc_nulls_last(), "model"), preds, failures


# ------------------------------------------------------------------ M16-M22
def standardize(df: DataFrame, cols: list[str] | None = None, exclude=(), prefix: str = "z_") -> tuple[DataFrame, list]:
    """Numeric columns with no null, at least 2; population std; a constant
    column becomes 0.  Adds ``z_<col>`` columns; returns (frame, scaled names)."""
    cand = [c for c in (cols or numeric_columns(df)) if c not in exclude]
    if not cand:
        raise ValueError("the dataset needs at least 2 numeric columns")
    aggs = []
    for i, c in enumerate(cand):
        x = present(df, c).cast("double")
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    use = [(c, r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cand) if r[f"n{i}"] == 0]
    if len(use) < 2:
        raise ValueError("the dataset needs at least 2 numeric columns without nulls")
    exprs = {}
    for c, m, s in use:
        scale = s if s not in (None, 0) else 1.0
        exprs[prefix + c] = (_q(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(scale)
    return df.withColumns(exprs), [prefix + c for c, _, _ in use]


def vectors_from_array(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col)))


def kmeans(df: DataFrame, k: int = 3, n_init: int = 10, seed: int = 42, features: str = "features",
           out: str = "Cluster", max_iter: int = 300):
    """Best of ``n_init`` starts by inertia; ties -> lower start.  All starts move in one pass per iteration.
    Returns (model with ``centers`` and ``inertia``, frame + ``Cluster``, inertia)."""
    found = fit_starts(df, [k], n_init, seed, features, max_iter)
    if not found:
        raise ValueError("no rows with whole features to cluster")
    return found[k], found[k].transform(df, features, out), found[k].inertia


def silhouette(pred: DataFrame, features: str = "features", cluster: str = "Cluster") -> float:
    """Mean silhouette by squared Euclidean distance (Spark's evaluator): the mean distance of a row to a cluster has a closed form
    in the cluster's size, vector sum and sum of squared norms, so the cost is linear."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(pred)


def cluster_sizes(pred: DataFrame, cluster: str = "Cluster", digits: int = 2) -> DataFrame:
    """Rows and share (%) per cluster."""
    g = pred.groupBy(_q(cluster).alias(cluster)).agg(F.count("*").alias("count"))
    tot = g.agg(F.sum("count").alias("total"))
    return g.crossJoin(F.broadcast(tot)).select(
        cluster, "count", F.round(F.col("count") * 100.0 / F.col("total"), digits).alias("share_pct"))


def elbow(df: DataFrame, k_max: int = 10, n_init: int = 10, seed: int = 42, features: str = "features",
          n_rows: int | None = None, max_iter: int = 300) -> DataFrame:
    """(k, inertia) for k = 2 .. min(k_max, n - 1); all (k, start) models move in one pass per iteration."""
    n = n_rows if n_rows is not None else df.count()
    ks = list(range(2, min(k_max + 1, n)))
    found = fit_starts(df, ks, n_init, seed, features, max_iter) if ks else {}
    rows = [(k, float(found[k].inertia)) for k in ks if k in found]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def pca(df: DataFrame, k: int = 2, features: str = "features", n_features: int | None = None,
        n_rows: int | None = None):
    """``k`` components (capped by columns and rows); the data is centred here, so every
    component has mean 0.

    Signs are fixed so each component's largest-magnitude loading is positive.
    Returns (projection frame with ``pca`` array, components (list of lists),
    explained variance ratios)."""
    if n_features is None:
        n_features = len(df.select(features).first()[0])
    k = min(k, n_features, n_rows if n_rows is not None else df.count())
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred)
    projected = model.transform(centred).drop("_centred")
    comps = model.pc.toArray().T.tolist()
    signs = []
    for comp in comps:
        j = max(range(len(comp)), key=lambda i: abs(comp[i]))
        signs.append(1.0 if comp[j] >= 0 else -1.0)
    comps = [[v * s for v in comp] for comp, s in zip(comps, signs)]
    arr = vector_to_array(F.col("_pc"))
    proj = projected.withColumn("pca", F.array(*[arr[i] * F.lit(signs[i]) for i in range(k)])).drop("_pc")
    return proj, comps, [float(x) for x in model.explainedVariance.toArray()]


def cumulative_variance(df: DataFrame, features: str = "features", target: float = 0.9) -> DataFrame:
    """Explained variance per component, running total, and whether the target
    is reached (one full PCA)."""
    n_features = len(df.select(features).first()[0])
    _, _, ratios = pca(df, k=n_features, features=features, n_features=n_features, n_rows=n_features)
    rows, acc, hit = [], 0.0, None
    for i, r in enumerate(ratios, 1):
        acc += r
        if hit is None and acc >= target - 1e-12:
            hit = i
        rows.append((i, r, acc, hit == i))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, reaches_target boolean")
