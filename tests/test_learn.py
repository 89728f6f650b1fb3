"""Property tests for the learning operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeda.operators import clustering, learn as L
from sparkeda.operators.clustering import fit_starts


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centers = [(0.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(float(cx + rng.normal()), float(cy + rng.normal()), t) for t, (cx, cy) in enumerate(centers)
            for _ in range(60)]
    return spark.createDataFrame(rows, "x double, y double, truth int")


def test_standardize_and_kmeans(blobs):
    d, cols = L.standardize(blobs, exclude=("truth",))
    st = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    for c in cols:
        assert abs(st[f"m_{c}"]) < 1e-9 and st[f"s_{c}"] == pytest.approx(1.0)
    v = L.assemble(d, cols)
    _, pred, cost = L.kmeans(v, k=3, n_init=3)
    pairs = pred.groupBy("truth").agg(F.countDistinct("Cluster").alias("n"), F.first("Cluster").alias("c")).collect()
    assert all(p.n == 1 for p in pairs) and len({p.c for p in pairs}) == 3
    assert 0.5 < L.silhouette(pred) <= 1.0
    sizes = {r.Cluster: r.share_pct for r in L.cluster_sizes(pred).collect()}
    assert sum(sizes.values()) == pytest.approx(100.0, abs=0.05)
    el = L.elbow(v, k_max=4, n_init=2).orderBy("k").collect()
    assert [r.k for r in el] == [2, 3, 4] and el[0].inertia > el[1].inertia


def test_all_starts_move_together(spark, blobs, monkeypatch):
    """The least inertia of many starts is that of separate fits, in a job count that does not grow with the models."""
    from pyspark.ml.clustering import KMeans

    v = L.assemble(blobs, ["x", "y"])
    found = fit_starts(v, [2, 3, 5], n_init=10)
    for k in (2, 3):
        separate = min(KMeans(k=k, seed=s).fit(v).summary.trainingCost for s in range(8))
        assert found[k].inertia == pytest.approx(separate, rel=1e-6)
    assert found[5].inertia < found[3].inertia and found[5].k == 5
    m = found[3]
    near = m.transform(v).collect()
    x = np.array([[r.x, r.y] for r in near])
    assert [r.Cluster for r in near] == ((x[:, None] - m.centers) ** 2).sum(2).argmin(1).tolist()
    assert m.inertia == pytest.approx(((x[:, None] - m.centers) ** 2).sum(2).min(1).sum())
    assert fit_starts(v, [3], n_init=10)[3].inertia == pytest.approx(m.inertia)
    monkeypatch.setattr(clustering, "FEW_SUMS", 0)  # sums that are aggregated on the cluster first are the same
    assert fit_starts(v, [3], n_init=10)[3].inertia == pytest.approx(m.inertia)


def test_starts_on_odd_rows(spark):
    nan = float("nan")
    d = spark.createDataFrame([([1.0, 1.0],), ([1.0, 1.0],), ([5.0, 5.0],), (None,), ([nan, 1.0],), ([None, 2.0],)], "features array<double>")
    found = fit_starts(d, [2, 4], n_init=3)
    assert found[2].inertia == 0 and sorted(found[2].centers[:, 0]) == [1.0, 5.0] and found[4].k == 2
    assert fit_starts(d.limit(0), [2]) == {}


def test_pca_and_cumulative(blobs):
    d, cols = L.standardize(blobs, exclude=("truth",))
    v = L.assemble(d, cols)
    proj, comps, ratios = L.pca(v, k=5)
    assert len(ratios) == 2 and sum(ratios) == pytest.approx(1.0) and all(max(c, key=abs) > 0 for c in comps)
    cv = L.cumulative_variance(v).collect()
    assert cv[-1].cumulative == pytest.approx(1.0) and sum(r.reaches_target for r in cv) == 1


def test_split_properties(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    tr, te = L.split(df, 0.2, 42, key=["id"])
    a, b = {r.id for r in tr.collect()}, {r.id for r in te.collect()}
    assert not (a & b) and len(a | b) == 5000 and 800 < len(b) < 1200
    tr2, te2 = L.split(df.orderBy(F.desc("id")), 0.2, 42, key=["id"])
    assert {r.id for r in te2.collect()} == b
    s_tr, s_te = L.stratified_split(df, "g", 0.2, 42, key=["id"])
    counts = {r.g: r["count"] for r in s_te.groupBy("g").count().collect()}
    assert all(abs(c - 5000 / 3 * 0.2) <= 60 for c in counts.values())
    assert s_tr.count() + s_te.count() == 5000


def test_metrics_vs_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "b")]  # class c never predicted
    p = spark.createDataFrame(rows, "label string, prediction string")
    m = L.classification_metrics(p).first()
    # per class: a p=1 r=.5 f=.667 s=2; b p=.5 r=1 f=.667 s=2; c 0 0 0 s=1
    assert m.accuracy == 0.6 and m.precision == 0.6 and m.recall == 0.6 and m.f1 == pytest.approx(0.5333, abs=1e-4)
    rep = {r["class"]: r for r in L.class_report(p).collect()}
    assert rep["c"].precision == 0.0 and rep["macro avg"].recall == pytest.approx(0.5, abs=1e-4)
    conf = {r.label: (r.a, r.b, r.c) for r in L.confusion(p, ["a", "b", "c"]).collect()}
    assert conf == {"a": (1, 1, 0), "b": (0, 2, 0), "c": (0, 1, 0)}
    t = spark.createDataFrame([("m1", 0.5), ("m2", 0.7)], "model string, f1 double")
    assert L.best_model(t).first().model == "m2"
    reg = L.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "label double, prediction double")).first()
    assert reg.rmse == pytest.approx((4 / 3) ** 0.5) and reg.r2 == pytest.approx(1 - 4 / 2)


def test_compare_models_and_features(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(x * 2 + rng.normal()), "u" if x > 0 else "v", int(x > 0), f"id{i}") for i, x in
            enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "x double, y double, cat string, target int, name string")
    roles = {r.column_name: r.role for r in L.usable_features(df, "target").collect()}
    assert roles == {"x": "numeric", "y": "numeric", "cat": "categorical", "name": "excluded"}
    data, feats, classes = L.prepare_classification(df, "target")
    assert [r.name for r in feats.orderBy("place").collect()] == ["x", "y", "cat_v"]
    assert [tuple(r) for r in classes.orderBy("label").collect()] == [(0.0, 0.0), (1.0, 1.0)]
    tr, te = L.split(data, 0.2, 42)
    table, preds, failures = L.compare_models(tr, te)
    rows = table.collect()
    assert not failures and len(rows) == 3 and rows[0].f1 >= rows[-1].f1 and rows[0].f1 > 0.9
    assert all(r.error is None for r in rows)
    onehot, names = L.one_hot(spark.createDataFrame([("x",), ("y",), (None,)], "c string"), ["c"])
    assert names == ["c_y"] and [r.c_y for r in onehot.collect()] == [0, 1, 0]


def test_one_hot_keeps_every_category(spark):
    df = spark.createDataFrame([(f"c{i % 1200:04d}" if i else None, i % 2) for i in range(13_000)], "c string, y int")
    d, vectors, names = L.one_hot_vectors(df, ["c"])
    assert names.count() == 1199 and d.select(vectors[0]).first()[0].size == 1199
    assert d.where("c IS NULL OR c = 'c0000'").first()[vectors[0]].numNonzeros() == 0
    data, feats, _ = L.prepare_classification(df, "y")
    assert feats.count() == 1199 and data.first().features.size == 1199


@pytest.mark.parametrize("labels,classes", [([-1, 1, None], [-1.0, 1.0]), ([2021, 2023, 150], [150.0, 2021.0, 2023.0]), (["b", None, "a"], ["a", "b", "nan"])])
def test_any_label_trains(spark, labels, classes):
    kind = "string" if isinstance(labels[0], str) else "int"
    df = spark.createDataFrame([(float(i % 3), labels[i % 3]) for i in range(60)], f"`x.y` double, t {kind}")
    data, _, found = L.prepare_classification(df, "t")
    assert [r.value for r in found.orderBy("label").collect()] == classes and set(r.label for r in data.collect()) == set(map(float, range(len(classes))))
    L.decision_tree().fit(data)


def test_pca_centres_and_metrics_skip_missing(spark, blobs):
    proj, _, _ = L.pca(L.assemble(blobs, ["x", "y"]), k=2)
    assert abs(proj.agg(F.avg(F.col("pca")[0])).first()[0]) < 1e-9
    nan = float("nan")
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0), (90.0, None), (None, 3.0), (nan, 1.0)], "label double, prediction double")
    r = L.regression_metrics(p).first()
    assert r.rmse == pytest.approx((4 / 3) ** 0.5) and r.r2 == pytest.approx(1 - 4 / 2)
    c = L.confusion(spark.createDataFrame([("a", "a"), ("a", "z")], "label string, prediction string"), ["a"]).first()
    assert c["a"] == 1 and c["(other)"] == 1
    z, cols = L.standardize(spark.createDataFrame([(1.0, 2.0, nan), (2.0, 4.0, 1.0)], "a double, b double, c double"))
    assert cols == ["z_a", "z_b"]


@pytest.mark.parametrize("rows", [1, 5, 400])
def test_exact_shares(spark, rows):
    """Every class gives its share, hot, small and null classes and repeated rows alike, and no row is lost."""
    df = spark.range(rows * 9).select(F.when(F.col("id") % 9 < 6, "hot").when(F.col("id") % 9 < 8, "mid").alias("g"), (F.col("id") % 50).alias("v"))
    df = df.unionByName(spark.createDataFrame([("few", 1), ("few", 1), ("few", 1)], "g string, v long")).unionByName(df.where("v = 7"))
    if df.groupBy("g").count().agg(F.min("count")).first()[0] < 2:
        df = df.unionByName(df)
    train, test = L.stratified_split(df, "g", 0.2, exact=True, bins=64)
    total, got = ({r.g: r["count"] for r in x.groupBy("g").count().collect()} for x in (df, test))
    assert {g: got.get(g, 0) for g in total} == {g: int(n * 0.2 + 0.5) for g, n in total.items()}
    both = sorted(map(tuple, train.unionByName(test).collect()), key=str)
    assert both == sorted(map(tuple, df.collect()), key=str)
    u = [L._hash01(["v", "g"], 42).alias("u"), "g"]
    low = {r.g: r.u for r in train.select(*u).groupBy("g").agg(F.min("u").alias("u")).collect()}
    assert all(r.u <= low[r.g] for r in test.select(*u).collect())


def test_running_equals_windows(spark):
    """Sums, counts, extremes, the row before and ranks, with one key in two thirds of the rows, null keys and null values."""
    from pyspark.sql import Window

    from sparkeda.operators.ordered import numbered, running
    rng = np.random.default_rng(6)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 7}", int(rng.integers(0, 40)), k, None if k % 5 == 0 else int(rng.integers(-9, 9))) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    w = Window.partitionBy("k").orderBy("t", "i")
    rw = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("*", F.sum("v").over(rw).alias("s"), F.count("v").over(rw).alias("c"), F.min("v").over(rw).alias("lo"), F.max("v").over(rw).alias("hi"),
                     F.lag("v").over(w).alias("p"), F.row_number().over(w).alias("n"))
    got = running(df, ["k"], ["t", "i"], {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "p": ("lag", "v"),
                                          "n": ("row_number", None)}, partitions=13)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    r = running(df, ["k"], [F.desc("t")], {"r": ("rank", None)}, partitions=9)
    assert sorted(map(tuple, r.collect()), key=str) == sorted(map(tuple, df.select("*", F.rank().over(Window.partitionBy("k").orderBy(F.desc("t"))).alias("r")).collect()), key=str)
    assert [tuple(x) for x in numbered(df, "t", "code").orderBy("code").collect()] == [(t, c) for c, t in enumerate(sorted({r[1] for r in rows}))]
    assert running(df.limit(0), ["k"], ["t"], {"s": ("sum", "v")}).collect() == []
    with pytest.raises(ValueError):
        running(df, ["k"], ["t"], {"s": ("median", "v")})


def test_a_pass_sends_the_driver_few_sums(spark, monkeypatch):
    """Many tasks over many centres send one row per centre, with the same sums as one task."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame
    from sparkeda.operators import clustering as K

    points = spark.range(640).selectExpr("array(cast(id % 17 AS double), cast(id % 29 AS double)) AS v")
    centers, cuts = np.array([[float(k % 10), float(k % 7)] for k in range(60)]), [0, 20, 60]
    received, real = [], DataFrame.toArrow

    def counted(self):
        out = real(self)
        received.append(out.num_rows)
        return out
    monkeypatch.setattr(DataFrame, "toArrow", counted)
    many = K._move(points.repartition(64), centers, cuts, 64)
    one = K._move(points.coalesce(1), centers, cuts, 1)
    assert received == [60, 60] and all(np.allclose(a, b) for a, b in zip(many, one))


def test_a_fit_reads_rows_that_were_prepared_once(spark):
    """The queries with one model fit it on kept rows; what was kept goes after the fit."""
    from sparkeda.plans import q_learn

    seen = []

    class Estimator:
        def fit(self, df):
            seen.append(df)
            assert df.storageLevel.useDisk and set(df.columns) == {"features", "label"}
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.col("label"))

    q_learn._fit_predict(spark, "/root/testdata/sf0.001", lambda train: Estimator())
    assert len(seen) == 1 and not seen[0].storageLevel.useDisk
