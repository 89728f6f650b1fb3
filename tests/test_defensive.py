"""The reference's only test: a poison frame through mean imputation and z-score.
Here the expected values are asserted."""

import math

import pytest

from sparkeda.operators.clean import Imputer, Scaler
from sparkeda.plans.pipeline import Pipeline

POISON = [(10.0, "Isaac", 5, None), (20.0, "Manuel", 5, None), (None, "Félix", 5, None), (40.0, "Eduardo", 5, None)]
SCHEMA = "Normal double, Columna_Texto string, Columna_Constante int, Columna_Vacia double"


def test_poison_frame(spark):
    df = spark.createDataFrame(POISON, SCHEMA)
    with pytest.warns(UserWarning):
        imp = Imputer("mean", ["Normal", "Columna_Texto", "Columna_Constante"]).fit(df)
    assert "Columna_Texto" not in imp.values_
    filled = imp.transform(df)
    normal = [r[0] for r in filled.select("Normal").collect()]
    assert normal[2] == pytest.approx(70.0 / 3)
    scaled = Scaler("zscore").fit_transform(filled).collect()
    assert scaled[2]["Normal"] == pytest.approx(0.0, abs=1e-12)
    assert [r["Columna_Texto"] for r in scaled] == ["Isaac", "Manuel", "Félix", "Eduardo"]
    assert all(r["Columna_Constante"] == 0 for r in scaled)
    assert all(r["Columna_Vacia"] is None for r in scaled)


def test_poison_pipeline_runs(spark):
    df = spark.createDataFrame(POISON, SCHEMA)
    p = Pipeline(test_size=0.0).add_step(Imputer("mean", ["Normal", "Columna_Constante"])).add_step(Scaler("zscore"))
    res = p.run(df)
    assert res.ok, res.error
    rows = res.train.collect()
    assert len(rows) == 4
    assert all(not (r["Normal"] is None or math.isnan(r["Normal"])) for r in rows)


def test_pipeline_reports_failing_step(spark):
    class Broken(Imputer):
        def fit(self, df):
            raise RuntimeError("boom")

    df = spark.createDataFrame(POISON, SCHEMA)
    res = Pipeline().add_step(Scaler()).add_step(Broken()).run(df)
    assert not res.ok and res.failed_step == "1:Broken" and "boom" in res.error


def test_mode_ties_numeric_order(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (10.0,), (9.0,), (None,)], "x double")
    assert Imputer("mode", ["x"]).fit(df).values_ == {"x": "9.0"}


def test_minmax_and_mode(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (5.0, None)], "x double, s string")
    out = Scaler("minmax").fit_transform(df).collect()
    assert [r.x for r in out] == [0.0, 0.5, None, 1.0]
    m = Imputer("mode", ["x", "s"]).fit(df)
    assert m.values_ == {"x": "1.0", "s": "b"}
    filled = m.transform(df).collect()
    assert filled[2].x == 1.0 and filled[3].s == "b"
    med = Imputer("median", ["x"]).fit(df)
    assert med.values_["x"] == 3.0
