"""Nested payloads and documents (own fixtures)."""

import json

import pytest

from sparkeda.operators import nested as N
from sparkeda.sources.api import read_api_payloads

PAYLOADS = [
    ("/list", json.dumps([{"id": 1, "tags": ["a", "b"], "geo": {"lat": 1.5}}, {"id": 2, "tags": [], "geo": {"lat": 2.0}}])),
    ("/wrapped", json.dumps({"count": 1, "results": [{"id": 3, "tags": ["c"], "geo": {"lat": 0.5}}], "more": [9]})),
    ("/single", json.dumps({"id": 4, "geo": {"lat": 4.0}})),
]


def test_detect_and_flatten(spark):
    df = spark.createDataFrame(PAYLOADS, "endpoint string, body string")
    t = N.payloads_to_table(df, keep=["endpoint"]).orderBy("id").collect()
    assert [(r.endpoint, r.id, r.tags, r["geo.lat"]) for r in t] == [
        ("/list", 1, "a, b", 1.5), ("/list", 2, None, 2.0), ("/wrapped", 3, "c", 0.5), ("/single", 4, None, 4.0)]


def test_document_order(spark):
    df = spark.createDataFrame([("e", json.dumps([{"zeta": 1, "alpha": {"y": 2, "b": 3}, "mid": "x"}]))],
                               "endpoint string, body string")
    assert N.payloads_to_table(df, keep=["endpoint"]).columns == ["endpoint", "zeta", "alpha.y", "alpha.b", "mid"]


def test_first_list_key_wins(spark):
    df = spark.createDataFrame([("e", json.dumps({"id": 1, "tags": ["x", "y"]}))], "endpoint string, body string")
    recs = N.records_to_struct(N.detect_records(df))
    assert [r.value for r in recs.collect()] == ["x", "y"]


def test_records_at_path_and_missing_key(spark):
    df = spark.createDataFrame([("e", json.dumps({"data": {"items": [{"k": 1}, {"k": 2}]}}))], "endpoint string, body string")
    assert [r.k for r in N.payloads_to_table(df, path="data.items").collect()] == [1, 2]
    with pytest.raises(KeyError, match="items2"):
        N.records_at(df, "data.items2")


def test_empty_list_is_error(spark):
    df = spark.createDataFrame([("e", "[]")], "endpoint string, body string")
    with pytest.raises(ValueError):
        read_api_payloads(spark, df)


def test_join_maps_and_arrays(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, [1, 2]), ({}, [])], "m map<string,int>, xs array<int>")
    r = N.flatten_complex_cells(df).collect()
    assert (r[0].m, r[0].xs) == ("a=1, b=2", "1, 2") and (r[1].m, r[1].xs) == (None, None)
    r2 = N.join_arrays(df, ["xs"], empty_as_null=False).collect()
    assert r2[1].xs == ""


STUDENT = {"_id": "E001", "datos_personales": {"nombre": "Ana", "apellido": "Ruiz", "edad": 21, "correo": "a@x.mx"},
           "academico": {"carrera": "ISC", "semestre": 4, "promedio": 9.1, "materias_cursadas": ["BD", "IA"]},
           "contacto": {"telefono": "555", "direccion": {"calle": "A 1", "ciudad": "CDMX", "codigo_postal": "07738"}},
           "fecha_inscripcion": "2023-08-01", "activo": True}
COURSE = {"_id": "C01", "info": {"nombre": "BD", "creditos": 8, "departamento": "Sistemas"},
          "profesor": {"nombre": "Dr. X", "titulo": "Dr."}, "horario": [
              {"dia": "Lunes", "hora_inicio": "07:00", "hora_fin": "08:30"},
              {"dia": "Jueves", "hora_inicio": "10:00", "hora_fin": "11:30"}], "cupo_maximo": 30, "inscritos": 25}


def test_flatten_documents(spark, tmpdir_path):
    from sparkeda.sources.files import read_json
    p1, p2 = f"{tmpdir_path}/est.json", f"{tmpdir_path}/cur.json"
    open(p1, "w").write(json.dumps([STUDENT], indent=2))
    open(p2, "w").write(json.dumps([COURSE], indent=2))
    s = N.flatten_students(read_json(spark, p1, multi_line=True))
    assert len(s.columns) == 15
    r = s.first()
    assert (r.num_materias, r.materias, r.ciudad, r.edad) == (2, "BD, IA", "CDMX", 21)
    c = N.flatten_courses(read_json(spark, p2, multi_line=True))
    assert len(c.columns) == 11
    r = c.first()
    assert (r.dias, r.horario, r.ocupacion_pct) == ("Lunes, Jueves", "Lunes 07:00-08:30; Jueves 10:00-11:30", 83.3)
    flat = N.flatten(read_json(spark, p1, multi_line=True))
    assert "contacto.direccion.ciudad" in flat.columns


def test_bad_payloads_do_not_stop_a_load(spark):
    bodies = ['{"data": {"o\'k": [{"id": 12345678901234567890123, "x": 1.5}]}}', '{"error": "busy"}', "{broken", None]
    df = spark.createDataFrame([("e", b) for b in bodies], "endpoint string, body string")
    ds = read_api_payloads(spark, df, path="data.o'k")
    rows = ds.df.collect()
    assert len(rows) == 1 and int(rows[0].id) == 12345678901234567890123 and rows[0].x == 1.5
    assert ds.metadata["malformed"] == 1 and ds.metadata["without_path"] == 1
    with pytest.raises(KeyError):
        read_api_payloads(spark, df, path="data.o'k", strict=True)
    assert N.detect_records(df).count() == 2
    bad = {r.reason: r.body for r in N.bad_payloads(df, path="data.o'k").collect()}
    assert bad == {"malformed": "{broken", "without_path": '{"error": "busy"}'}


def test_payloads_are_parsed_once(spark):
    df = spark.createDataFrame([("e", json.dumps({"data": {"items": [{"b": 1, "a": [1, 2]}, {"b": None, "c": {"d": "x"}}]}}))] * 3, "endpoint string, body string")
    for path in ("data.items", None):
        t = N.payloads_to_table(df, path=path, keep=["endpoint"])
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") <= 1 and "InMemoryRelation" in plan
    assert N.payloads_to_table(df, path="data.items").columns == ["b", "a", "c.d"]
    with pytest.raises(KeyError, match="items"):
        N.records_at(spark.createDataFrame([("{\"data\": {\"items\": null}}",)], "body string"), "data.items")
