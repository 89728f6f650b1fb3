"""Registered learning queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from sparkeda.operators import learn as L
from sparkeda.plans.catalog import register, round_doubles, tbl

CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

M1_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS \"distinct\", "
    f"count(DISTINCT {c}) <= greatest(20, count(*) * 0.1) AS candidate FROM customer" for c in CUST)


@register("m1_candidate_targets", M1_SQL)
def m1_candidate_targets(spark, sf_dir):
    return L.candidate_targets(tbl(spark, sf_dir, "customer"))


M2_SQL = ("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label "
          "FROM customer")


@register("m2_encode_label", M2_SQL)
def m2_encode_label(spark, sf_dir):
    d, _ = L.encode_label(tbl(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return d


M3_SQL = """
SELECT 'c_custkey' AS column_name, CASE WHEN count(*) FILTER (WHERE c_custkey IS NULL) > 0 THEN 'excluded' ELSE 'numeric' END AS role,
       CASE WHEN count(*) FILTER (WHERE c_custkey IS NULL) > 0 THEN 'has nulls' ELSE '' END AS reason FROM customer
UNION ALL
SELECT 'c_name', CASE WHEN count(DISTINCT c_name) > greatest(20, count(*) * 0.1) THEN 'excluded' ELSE 'categorical' END,
       CASE WHEN count(DISTINCT c_name) > greatest(20, count(*) * 0.1) THEN 'too many values' ELSE '' END FROM customer
UNION ALL
SELECT 'c_nationkey', CASE WHEN count(*) FILTER (WHERE c_nationkey IS NULL) > 0 THEN 'excluded' ELSE 'numeric' END,
       CASE WHEN count(*) FILTER (WHERE c_nationkey IS NULL) > 0 THEN 'has nulls' ELSE '' END FROM customer
UNION ALL
SELECT 'c_acctbal', 'excluded', 'user'
"""


@register("m3_usable_features", M3_SQL)
def m3_usable_features(spark, sf_dir):
    return L.usable_features(tbl(spark, sf_dir, "customer"), "c_mktsegment", exclude=("c_acctbal",))


# The market segments of the driver tables (oracle side only).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
M4_SQL = ("SELECT c_custkey, c_mktsegment, " + ", ".join(
    f"coalesce(CAST(c_mktsegment = '{s}' AS INTEGER), 0) AS \"c_mktsegment_{s}\"" for s in SEGMENTS[1:])
    + " FROM customer")


@register("m4_one_hot", M4_SQL)
def m4_one_hot(spark, sf_dir):
    d, _ = L.one_hot(tbl(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])
    return d


def _u(cols: str, seed: int = 42) -> str:
    """The split's hash in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {cols}, '{seed}')), 1, 13) AS BIGINT) / 4503599627370496.0"


@register("m5_split", f"SELECT *, CASE WHEN {_u('o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders")
def m5_split(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders")
    train, test = L.split(o, 0.2, 42, key=["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


M6_SQL = f"""SELECT o_orderpriority, CASE WHEN {_u('o_orderkey, o_orderpriority')} < 0.2 THEN 'test' ELSE 'train' END AS part,
  count(*) AS "count" FROM orders GROUP BY ALL"""


@register("m6_stratified_split", M6_SQL)
def m6_stratified_split(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders")
    train, test = L.stratified_split(o, "o_orderpriority", 0.2, 42, key=["o_orderkey"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("o_orderpriority", "part").count()


M6_EXACT_SQL = f"""SELECT o_orderkey, o_orderpriority, CASE WHEN i <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_u('o_orderkey, o_orderpriority')}) AS i,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""


@register("m6_stratified_exact", M6_EXACT_SQL)
def m6_stratified_exact(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    train, test = L.stratified_split(o, "o_orderpriority", 0.2, 42, key=["o_orderkey"], exact=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


M4_VECTORS_SQL = """WITH c AS (SELECT DISTINCT p_type AS v FROM part WHERE p_type IS NOT NULL),
i AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS place FROM c)
SELECT p_partkey, CAST(coalesce(place, -1) AS INTEGER) AS place, CASE WHEN place >= 0 THEN 'p_type_' || v END AS name
FROM part LEFT JOIN i ON p_type = v"""


@register("m4_one_hot_vectors", M4_VECTORS_SQL)
def m4_one_hot_vectors(spark, sf_dir):
    """Where each part's type stands in its vector, and what that place is called."""
    from pyspark.ml.functions import vector_to_array

    d, (vec,), names = L.one_hot_vectors(tbl(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"])
    at = F.array_position(vector_to_array(vec), F.lit(1.0)) - 1
    d = d.select("p_partkey", F.coalesce(at, F.lit(-1)).cast("int").alias("place"))
    return d.join(names.select(F.col("place").cast("int").alias("place"), "name"), "place", "left")


def planted(spark, sf_dir):
    """Lines labelled by a rule that the models can find, beside a column that says nothing."""
    li = tbl(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_tax"), (F.col("l_linenumber") >= 4).cast("int").alias("late"),
                     F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("line"))


PLANTED_TEST = f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 4 THEN 1 ELSE 0 END AS late FROM lineitem
WHERE {_u("l_orderkey || '-' || l_linenumber, CASE WHEN l_linenumber >= 4 THEN '1.0' ELSE '0.0' END")} < 0.2"""
PLANTED_SQL = f"SELECT l_orderkey, l_linenumber, CAST(late AS DOUBLE) AS prediction FROM ({PLANTED_TEST})"


def _prepared(spark, sf_dir):
    """Stratified parts (M6) of the prepared lines."""
    d = planted(spark, sf_dir)
    data, _, _ = L.prepare_classification(d.withColumnRenamed("l_linenumber", "number").withColumn("l_linenumber", F.col("number")),
                                          "late", exclude=("l_orderkey",), key=["line", "l_linenumber"])
    return L.stratified_split(data, "label", 0.2, 42, key=["line"])


def _fit_predict(spark, sf_dir, est_fn):
    train, test = _prepared(spark, sf_dir)
    # a fit reads its rows several times: what it reads of them is prepared and split once, and kept on disk, so that memory stays the model's
    kept = train.select("features", "label").persist(StorageLevel.DISK_ONLY)
    p = est_fn(kept).fit(kept).transform(test)
    kept.unpersist()
    return p.select(F.split("line", "-")[0].cast("long").alias("l_orderkey"), "l_linenumber", "prediction")


@register("m7_decision_tree", PLANTED_SQL)
def m7_decision_tree(spark, sf_dir):
    return _fit_predict(spark, sf_dir, lambda tr: L.decision_tree())


@register("m8_logistic_regression", PLANTED_SQL)
def m8_logistic_regression(spark, sf_dir):
    return _fit_predict(spark, sf_dir, lambda tr: L.logistic_regression(tr.count()))


@register("m9_random_forest", PLANTED_SQL)
def m9_random_forest(spark, sf_dir):
    return _fit_predict(spark, sf_dir, lambda tr: L.random_forest())


M12_SQL = f"""WITH t AS ({PLANTED_TEST})
SELECT model, round(avg(CASE WHEN late = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy, 1.0 AS precision, 1.0 AS recall, 1.0 AS f1,
  CAST(NULL AS VARCHAR) AS error
FROM (SELECT unnest(['decision_tree', 'logistic_regression', 'random_forest']) AS model, late, late AS guess FROM t) GROUP BY model"""


@register("m12_compare_models", M12_SQL)
def m12_compare_models(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    table, _, _ = L.compare_models(train, test)
    return table


PRED_SQL = ("SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS prediction "
            "FROM lineitem")


def line_predictions(spark, sf_dir):
    li = tbl(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"),
                     F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("prediction"))


_PC = f"""pc AS (
  SELECT cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
         coalesce(tp * 1.0 / nullif(predicted, 0), 0) AS precision, coalesce(tp * 1.0 / nullif(support, 0), 0) AS recall
  FROM (SELECT label AS cls, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM p GROUP BY 1) a
  FULL JOIN (SELECT prediction AS cls, count(*) AS predicted FROM p GROUP BY 1) b USING (cls)),
pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pc)"""

M10_SQL = f"""WITH p AS ({PRED_SQL}), {_PC}
SELECT round(sum(tp) * 1.0 / sum(support), 4) AS accuracy, round(sum(precision * support) / sum(support), 4) AS precision,
       round(sum(recall * support) / sum(support), 4) AS recall, round(sum(f1 * support) / sum(support), 4) AS f1 FROM pf"""


@register("m10_classification_metrics", M10_SQL)
def m10_classification_metrics(spark, sf_dir):
    return L.classification_metrics(line_predictions(spark, sf_dir))


M11_SQL = f"""WITH p AS ({PRED_SQL}), {_PC}
SELECT cls AS class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pf
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) * 1.0 / sum(support), 4), sum(support)::BIGINT FROM pf
UNION ALL
SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM pf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
       round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM pf"""


@register("m11_class_report", M11_SQL)
def m11_class_report(spark, sf_dir):
    return L.class_report(line_predictions(spark, sf_dir))


M13_PRED = ("SELECT 'by_status' AS model, l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END "
            "AS prediction FROM lineitem UNION ALL SELECT 'always_n', l_returnflag, 'N' FROM lineitem "
            "UNION ALL SELECT 'by_quantity', l_returnflag, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END FROM lineitem")
M13_SQL = f"""WITH p0 AS ({M13_PRED}),
a AS (SELECT model, label AS cls, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM p0 GROUP BY 1, 2),
b AS (SELECT model, prediction AS cls, count(*) AS predicted FROM p0 GROUP BY 1, 2),
pc AS (SELECT model, cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(tp * 1.0 / nullif(predicted, 0), 0) AS precision, coalesce(tp * 1.0 / nullif(support, 0), 0) AS recall
       FROM a FULL JOIN b USING (model, cls)),
m AS (SELECT model, round(sum(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) * support) / sum(support), 4) AS f1
      FROM pc GROUP BY model)
SELECT model, f1 FROM m ORDER BY f1 DESC, model LIMIT 1"""


@register("m13_best_model", M13_SQL)
def m13_best_model(spark, sf_dir):
    li = tbl(spark, sf_dir, "lineitem")
    lab = F.col("l_returnflag").alias("label")
    p = (li.select(F.lit("by_status").alias("model"), lab,
                   F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("prediction"))
         .unionByName(li.select(F.lit("always_n").alias("model"), lab, F.lit("N").alias("prediction")))
         .unionByName(li.select(F.lit("by_quantity").alias("model"), lab,
                                F.when(F.col("l_quantity") > 25, "R").otherwise("N").alias("prediction"))))
    return L.best_model(L.classification_metrics(p, by=["model"]))


# The return flags of the driver tables (oracle side only).
FLAGS = ["A", "N", "R"]
M14_SQL = (f"WITH p AS ({PRED_SQL}) SELECT label, " + ", ".join(
    f"count(*) FILTER (WHERE prediction = '{f}') AS \"{f}\"" for f in FLAGS) + ", count(*) FILTER (WHERE prediction NOT IN ('A', 'N', 'R')) AS \"(other)\" FROM p GROUP BY label")


@register("m14_confusion", M14_SQL)
def m14_confusion(spark, sf_dir):
    return L.confusion(line_predictions(spark, sf_dir), FLAGS)


M15_SQL = """WITH p AS (SELECT l_extendedprice AS label, l_quantity * p_retailprice AS prediction
                   FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT round(sqrt(avg(power(label - prediction, 2))), 4) AS rmse,
       round(1 - sum(power(label - prediction, 2)) / nullif(sum(power(label - (SELECT avg(label) FROM p), 2)), 0), 6) AS r2
FROM p"""


@register("m15_regression_metrics", M15_SQL)
def m15_regression_metrics(spark, sf_dir):
    li, pt = tbl(spark, sf_dir, "lineitem"), tbl(spark, sf_dir, "part")
    p = li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    r = L.regression_metrics(p)
    return r.select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


M16_SQL = """SELECT c_custkey, """ + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM customer)) / coalesce(nullif((SELECT stddev_pop({c}) FROM customer), 0), 1), 6) AS z_{c}"
    for c in ["c_custkey", "c_nationkey", "c_acctbal"]) + " FROM customer"


@register("m16_standardize", M16_SQL)
def m16_standardize(spark, sf_dir):
    c = tbl(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    d, cols = L.standardize(c)
    return round_doubles(d.select("c_custkey", *cols), 6)


def _vectors(spark, sf_dir):
    e = tbl(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = e.select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(n)])
    z, cols = L.standardize(wide, [f"e{k}" for k in range(n)])  # M16 first, as the reference does
    return L.assemble(z, cols).select("vec_id", "label", "features")


def _two(spark, sf_dir):
    """Two standardised columns: the components are their sum and difference over the square root of 2."""
    li = tbl(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                               (F.col("l_quantity") + 2 * F.col("l_linenumber")).alias("more"))
    z, cols = L.standardize(li, ["l_quantity", "more"])
    return L.assemble(z, cols)


TWO_SQL = """z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
    (more - avg(more) OVER ()) / stddev_pop(more) OVER () AS b FROM (SELECT *, l_quantity + 2 * l_linenumber AS more FROM lineitem))"""


@register("m17_kmeans")
def m17_kmeans(spark, sf_dir):
    _, pred, _ = L.kmeans(_vectors(spark, sf_dir), k=3, n_init=10)
    return pred.select("vec_id", "Cluster")


@register("m18_silhouette")
def m18_silhouette(spark, sf_dir):
    _, pred, cost = L.kmeans(_vectors(spark, sf_dir), k=3, n_init=10)
    return spark.createDataFrame([(L.silhouette(pred), float(cost))], "silhouette double, inertia double")


def _flag_points(spark, sf_dir):
    """Lines as points that lie apart by return flag."""
    li = tbl(spark, sf_dir, "lineitem")
    far = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 400.0).otherwise(900.0)
    return li.select("l_returnflag", F.array(far + F.col("l_quantity"), far * 0.5 + F.col("l_linenumber")).alias("features"))


FLAG_POINTS = """p AS (SELECT l_returnflag AS f, far + l_quantity AS x, far * 0.5 + l_linenumber AS y FROM (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 400.0 ELSE 900.0 END AS far FROM lineitem))"""
M17_SQL = f"""WITH {FLAG_POINTS}
SELECT count(*) AS "count", round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(sum(var) OVER (), 0) AS inertia
FROM (SELECT *, 0 AS one FROM p) JOIN (SELECT f, count(*) * (var_pop(x) + var_pop(y)) AS var FROM p GROUP BY f) USING (f) GROUP BY f, var"""


@register("m17_kmeans_planted", M17_SQL)
def m17_kmeans_planted(spark, sf_dir):
    """Sizes, centres and inertia of three clusters, where the clusters are known."""
    _, pred, cost = L.kmeans(_flag_points(spark, sf_dir), k=3, n_init=10)
    return pred.groupBy("Cluster").agg(F.count("*").alias("count"), F.round(F.avg(F.col("features")[0]), 4).alias("x"),
                                       F.round(F.avg(F.col("features")[1]), 4).alias("y")).select(
        "count", "x", "y", F.lit(float(round(cost))).alias("inertia"))


M18_SQL = f"""WITH {FLAG_POINTS},
c AS (SELECT f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM p GROUP BY f),
d AS (SELECT p.f, x, y, c.f AS o, (c.n * (x * x + y * y) - 2 * (x * sx + y * sy) + q) AS far, c.n AS n FROM p, c),
s AS (SELECT max(CASE WHEN f = o THEN far / (n - 1) END) AS a, min(CASE WHEN f <> o THEN far / n END) AS b, count(*) AS k FROM
      (SELECT *, row_number() OVER (PARTITION BY o ORDER BY f, x, y) AS i FROM d) GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette FROM s"""


@register("m18_silhouette_planted", M18_SQL)
def m18_silhouette_planted(spark, sf_dir):
    """The mean silhouette of the lines clustered by their flag."""
    from pyspark.ml.functions import array_to_vector

    p = _flag_points(spark, sf_dir).select(array_to_vector("features").alias("features"), F.when(
        F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("Cluster"))
    return spark.createDataFrame([(round(L.silhouette(p), 4),)], "silhouette double")


M19_SQL = """SELECT label AS "Cluster", count(*) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 2) AS share_pct
FROM embeddings GROUP BY label"""


@register("m19_cluster_sizes", M19_SQL)
def m19_cluster_sizes(spark, sf_dir):
    e = tbl(spark, sf_dir, "embeddings").withColumnRenamed("label", "Cluster")
    return L.cluster_sizes(e)


@register("m20_elbow")
def m20_elbow(spark, sf_dir):
    return L.elbow(_vectors(spark, sf_dir), k_max=10, n_init=10)


M20_SQL = f"""WITH {FLAG_POINTS}, c AS (SELECT f, count(*) AS n, avg(x) AS x, avg(y) AS y, count(*) * (var_pop(x) + var_pop(y)) AS w FROM p GROUP BY f),
t AS (SELECT sum(w) AS w FROM c),
two AS (SELECT min(a.n * b.n / (a.n + b.n) * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS more FROM c a JOIN c b ON a.f < b.f)
SELECT 2 AS k, round((w + more) / 1000) AS inertia FROM t, two UNION ALL SELECT 3, round(w / 1000) FROM t"""


@register("m20_elbow_planted", M20_SQL)
def m20_elbow_planted(spark, sf_dir):
    """Two centres merge the two clusters that cost least, three find each its own."""
    return L.elbow(_flag_points(spark, sf_dir), k_max=3, n_init=10).select("k", F.round(F.col("inertia") / 1000).alias("inertia"))


M21_SQL = f"""WITH {TWO_SQL}
SELECT l_orderkey, l_linenumber, round((a + b) / sqrt(2), 4) AS pc1, round(abs(a - b) / sqrt(2), 4) AS pc2 FROM z"""


@register("m21_pca", M21_SQL)
def m21_pca(spark, sf_dir):
    proj, _, _ = L.pca(_two(spark, sf_dir), k=2)  # the second component's sign is a tie: its size is compared
    return proj.select("l_orderkey", "l_linenumber", F.round(F.col("pca")[0], 4).alias("pc1"), F.round(F.abs(F.col("pca")[1]), 4).alias("pc2"))


M22_SQL = f"""WITH {TWO_SQL}, r AS (SELECT avg(a * b) AS r FROM z)
SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative, (1 + r) / 2 >= 0.9 AS reaches_target FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0, (1 + r) / 2 < 0.9 FROM r"""


@register("m22_cumulative_variance", M22_SQL)
def m22_cumulative_variance(spark, sf_dir):
    return round_doubles(L.cumulative_variance(_two(spark, sf_dir), target=0.9), 6)


#: Lines with a quantity left out in every seventh order, filled with the mean and scaled; fitted stages are saved and read back.
U1_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, l_tax FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, coalesce(q, avg(q) OVER ()) AS q, l_tax FROM l)
SELECT l_orderkey, l_linenumber, round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) AS l_quantity,
  round((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 6) AS l_tax FROM f"""


@register("u1_pipeline_stages", U1_SQL)
def u1_pipeline_stages(spark, sf_dir):
    import uuid

    from pyspark.ml import Pipeline, PipelineModel

    from sparkeda.operators.clean import Imputer, Scaler
    from sparkeda.operators.stages import TransformStage
    from sparkeda.session import checkpoint_dir

    d = tbl(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    stages = [TransformStage(Imputer("mean", ["l_quantity"])), TransformStage(Scaler("zscore", ["l_quantity"])), TransformStage(Scaler("minmax", ["l_tax"]))]
    path = f"{checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(d).write().save(path)
    return round_doubles(PipelineModel.load(path).transform(d), 6)


U3_SQL = f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 4 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM lineitem
WHERE {_u("l_orderkey || '-' || l_linenumber")} < 0.2"""


@register("u3_pipeline", U3_SQL)
def u3_pipeline(spark, sf_dir):
    """Split, impute, scale, train (a U2 model) and predict; the label is known from a column of its own."""
    from sparkeda.operators.clean import Imputer, Scaler
    from sparkeda.plans.pipeline import Pipeline

    d = planted(spark, sf_dir).withColumns({"number": F.col("l_linenumber").cast("double"), "label": F.col("late").cast("double"),
                                            "gap": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))})
    p = Pipeline(0.2, 42, split_key=["line"]).add_step(Imputer("median", ["gap"])).add_step(Scaler("zscore", ["number", "gap"]))
    p.set_model(L.SupervisedModel(L.decision_tree()), prepare=lambda x: L.assemble(x, ["number", "gap"]))
    res = p.run(d)
    if not res.ok:
        raise RuntimeError(f"{res.failed_step}: {res.error}")
    return res.predictions.select("l_orderkey", "l_linenumber", "prediction")
