import numpy as np
import pytest

from sparkeda.operators import profile as P


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 1.5), rng.integers(0, 5, 700).astype(float)])
    df = spark.createDataFrame([(float(v), float(v) * 2) for v in vals], "a double, b double")
    for final_rows, accuracy, bins in ((50, 10_000, 16), (10_000, 10_000, 1024), (50, 100, 16), (40, 20, 4)):
        q = P.exact_quantiles(df, ["a", "b"], (0.1, 0.25, 0.5, 0.75, 0.9), final_rows=final_rows, bins=bins)
        for p in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert q["a"][p] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-12)
            assert q["b"][p] == pytest.approx(float(np.percentile(vals * 2, p * 100)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_edge_cases(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 5.0), (3.0, None, 5.0)], "a double, e double, k double")
    q = P.exact_quantiles(df, ["a", "e", "k"], (0.0, 0.5, 1.0))
    assert q["a"] == {0.0: 1.0, 0.5: 2.0, 1.0: 3.0}
    assert q["e"] == {0.0: None, 0.5: None, 1.0: None}
    assert q["k"] == {0.0: 5.0, 0.5: 5.0, 1.0: 5.0}
    one = spark.createDataFrame([(7.0,)], "a double")
    assert P.exact_quantiles(one, ["a"], (0.25,))["a"][0.25] == 7.0


def test_histogram_matches_numpy(spark):
    vals = [0.0, 0.1, 0.1, 0.35, 0.5, 0.5, 0.99, 1.0, 2.0, 2.0]
    df = spark.createDataFrame([(v, 3.0) for v in vals], "x double, c double")
    h = P.histogram(df, ["x", "c"], bins=4).orderBy("column_name", "bin").collect()
    counts, edges = np.histogram(vals, bins=4)
    got = [r["count"] for r in h if r["column_name"] == "x"]
    assert got == counts.tolist()
    assert [r["lower"] for r in h if r["column_name"] == "x"] == pytest.approx(edges[:-1].tolist())
    const = [r for r in h if r["column_name"] == "c"]
    assert const[0]["lower"] == 2.5 and const[-1]["upper"] == 3.5 and sum(r["count"] for r in const) == 10
    assert [r["median"] for r in h if r["column_name"] == "x"][0] == pytest.approx(float(np.median(vals)))


def test_value_counts_ties_and_top(spark):
    df = spark.createDataFrame([(v,) for v in "b a c a b d e".split()] + [(None,)], "s string")
    rows = P.value_counts(df, ["s"], top=3).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in rows] == [("a", 2), ("b", 2), ("c", 1)]


def test_value_counts_numeric_ties(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (100,)], "n int")
    rows = P.value_counts(df, ["n"], top=2).orderBy("rank").collect()
    assert [r.value for r in rows] == ["9", "10"]


def test_correlation_constant_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 8.2, 5.0)],
                               "a double, b double, k double")
    r = {(x.col_a, x.col_b): x.corr for x in P.correlation(df).collect()}
    assert r[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.1, 8.2])[0, 1])
    assert r[("a", "k")] is None and r[("k", "k")] is None
    assert r[("a", "a")] == pytest.approx(1.0)


def test_describe_and_text(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (None, None)], "n int, s string")
    d = P.describe(df).collect()[0]
    assert d["count"] == 3 and d["mean"] == 2.0 and d["std"] == 1.0 and d["p50"] == 2.0 and d["p25"] == 1.5
    t = P.describe_text(df).collect()[0]
    assert (t["count"], t["unique"], t["top"], t["freq"]) == (3, 2, "x", 2)
    prof = {r.column_name: r for r in P.column_profile(df).collect()}
    assert prof["n"].nulls == 1 and prof["n"].distinct == 3 and prof["s"].type == "string"
    nulls = {r.column_name: r.nulls for r in P.null_profile(df).collect()}
    assert nulls == {"n": 1, "s": 1, "(total)": 2}
    sm = P.shape_metrics(df).first()
    assert (sm.rows, sm.columns, sm.nulls, sm.numeric_columns) == (4, 2, 2, 1)


def test_group_mean_and_top(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", 4.0)], "k string, v double")
    g = {r.k: (r.mean, r.above) for r in P.group_mean(df, "k", "v").collect()}
    assert g == {"a": (2.0, False), "b": (10.0, True), "c": (4.0, False)}
    sc = spark.createDataFrame([(1, "10", "x"), (1, "20", None), (2, "5", "7"), (3, None, None)],
                               "id int, p1 string, p2 string")
    top = P.top_by_row_mean(sc, "id", ["p1", "p2"], n=10).collect()
    assert [(r.id, r.mean_score) for r in top] == [(1, 15.0), (2, 6.0), (3, None)]


def test_class_counts_check(spark):
    df = spark.createDataFrame([(1,), (1,)], "y int")
    with pytest.raises(ValueError):
        P.class_counts(df, "y", check=True)


def test_exact_quantiles_with_infinities(spark):
    vals = [float("-inf"), 1.0, 2.0, 3.0, float("inf"), 5.0] + [float(i) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    for kw in (dict(), dict(final_rows=3, bins=4)):
        q = P.exact_quantiles(df, ["a"], (0.0, 0.25, 0.5, 1.0), **kw)["a"]
        assert q[0.0] == float("-inf") and q[1.0] == float("inf")
        assert q[0.25] == pytest.approx(float(np.percentile(vals, 25))) and q[0.5] == pytest.approx(97.5)
    h = P.histogram(df, ["a"], bins=4).collect()
    assert sum(r["count"] for r in h) == len(vals) - 2


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=300),
       st.sampled_from([(16, 10, 20), (1024, 10_000, 10_000), (4, 5, 50)]))
def test_exact_quantiles_property(spark, vals, params):
    bins, final_rows, accuracy = params
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    q = P.exact_quantiles(df, ["a"], probs, bins=bins, final_rows=final_rows)["a"]
    for p in probs:
        assert q[p] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-9, abs=1e-9)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3).map(lambda v: v / 4.0), st.floats(-1e3, 1e3, allow_nan=False,
                                                                              allow_infinity=False)),
                min_size=1, max_size=200),
       st.sampled_from([3, 20]))
def test_histogram_property(spark, vals, bins):
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    h = P.histogram(df, ["a"], bins=bins).orderBy("bin").collect()
    lo, hi = min(vals), max(vals)
    rng = (lo - 0.5, hi + 0.5) if lo == hi else None
    counts, _ = np.histogram(vals, bins=bins, range=rng)
    assert [r["count"] for r in h] == counts.tolist()
