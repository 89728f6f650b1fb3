"""Registered nested-data queries (J1-J5, S11) over payloads derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.operators import nested as N
from sparkeda.plans.catalog import register, tbl
from sparkeda.session import spread
from sparkeda.sources.api import read_api_payloads


def event_payloads(spark, sf_dir):
    """One API-style payload per event: ``{"data": {"items": [ {...} ]}}``."""
    e = spread(tbl(spark, sf_dir, "events"))
    item = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"),
                    F.get_json_object("props", "$.k").cast("long").alias("k"),
                    F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("tags"),
                    F.struct(F.col("user_id").alias("user"), F.col("value").alias("value")).alias("meta"))
    body = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data")))
    return e.select(F.concat(F.lit("/events/"), F.col("event_type")).alias("endpoint"), body.alias("body"))


J1_SQL = """SELECT '/events/' || event_type AS endpoint, event_id AS id, event_type AS type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ', ' || CAST(user_id AS VARCHAR) AS tags,
  user_id AS "meta.user", value AS "meta.value" FROM events"""


@register("j1_records_at_path", J1_SQL)
def j1_records_at_path(spark, sf_dir):
    p = event_payloads(spark, sf_dir)
    return N.payloads_to_table(p, path="data.items", keep=["endpoint"])


J2_SQL = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


@register("j2_detect_records", J2_SQL)
def j2_detect_records(spark, sf_dir):
    e = tbl(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"))
    return N.flatten(N.records_to_struct(N.detect_records(e, keep=["event_id"]), keep=["event_id"]))


J3_SQL = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k",
  user_id AS "who.user", event_type AS "who.kind" FROM events"""


@register("j3_flatten", J3_SQL)
def j3_flatten(spark, sf_dir):
    e = tbl(spark, sf_dir, "events")
    nested = e.select("event_id", F.from_json("props", "k long").alias("props"),
                      F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"))
    return N.flatten(nested)


J4_SQL = """SELECT user_id, CASE WHEN event_type = 'click' THEN NULL
  ELSE event_type || ', ' || CAST(user_id AS VARCHAR) END AS tags FROM events"""


@register("j4_join_arrays", J4_SQL)
def j4_join_arrays(spark, sf_dir):
    e = tbl(spark, sf_dir, "events")
    arr = F.when(F.col("event_type") == "click", F.array().cast("array<string>")) \
        .otherwise(F.array("event_type", F.col("user_id").cast("string")))
    return N.join_arrays(e.select("user_id", arr.alias("tags")))


J5_SQL = """SELECT event_id, 'type=' || event_type || ', k=' || json_extract_string(props, '$.k') AS attrs FROM events"""


@register("j5_join_maps", J5_SQL)
def j5_join_maps(spark, sf_dir):
    e = tbl(spark, sf_dir, "events")
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return N.join_maps(e.select("event_id", m.alias("attrs")))


@register("s11_read_api_payloads", J1_SQL)
def s11_read_api_payloads(spark, sf_dir):
    return read_api_payloads(spark, event_payloads(spark, sf_dir), path="data.items").df


S11_BAD_SQL = """SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'malformed' ELSE 'without_path' END AS reason
FROM events WHERE event_id % 10 IN (3, 4)"""


@register("s11_bad_payloads", S11_BAD_SQL)
def s11_bad_payloads(spark, sf_dir):
    """Which payloads are cut short and which hold no records, of events where every tenth is so."""
    e = tbl(spark, sf_dir, "events")
    whole = F.concat(F.lit('{"data": {"items": ['), F.col("props"), F.lit("]}}"))
    body = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"data": '), F.col("props"))).when(
        F.col("event_id") % 10 == 4, F.concat(F.lit('{"error": '), F.col("props"), F.lit("}"))).otherwise(whole)
    return N.bad_payloads(e.select("event_id", body.alias("body")), path="data.items", keep=["event_id"]).select("event_id", "reason")


J6_SQL = """SELECT 'C' || c_custkey AS id, c_name AS nombre, c_mktsegment AS apellido, CAST(c_nationkey AS BIGINT) AS edad, 'c' || c_custkey || '@x.mx' AS correo,
  'S' || c_nationkey AS carrera, CAST(c_custkey % 9 AS BIGINT) AS semestre, c_acctbal AS promedio, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS num_materias,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || ', ' || c_name END AS materias, '55' || c_custkey AS telefono, 'N' || c_nationkey AS ciudad,
  'P' || c_nationkey AS codigo_postal, '2024-01-0' || (c_custkey % 9 + 1) AS fecha_inscripcion, CAST(c_custkey % 2 = 0 AS VARCHAR) AS activo FROM customer"""


@register("j6_flatten_students", J6_SQL)
def j6_flatten_students(spark, sf_dir):
    """Customers as nested student documents, flat again."""
    c, k = tbl(spark, sf_dir, "customer"), F.col("c_custkey")

    def text(lead, col):
        return F.concat(F.lit(lead), F.col(col).cast("string"))

    courses = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment", "c_name"))
    place = F.struct(F.lit("x").alias("calle"), text("N", "c_nationkey").alias("ciudad"), text("P", "c_nationkey").alias("codigo_postal"))
    docs = c.select(text("C", "c_custkey").alias("_id"), F.struct(
        F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("apellido"), F.col("c_nationkey").cast("long").alias("edad"),
        F.concat(text("c", "c_custkey"), F.lit("@x.mx")).alias("correo")).alias("datos_personales"),
        F.struct(text("S", "c_nationkey").alias("carrera"), (k % 9).alias("semestre"), F.col("c_acctbal").alias("promedio"),
                 courses.alias("materias_cursadas")).alias("academico"),
        F.struct(text("55", "c_custkey").alias("telefono"), place.alias("direccion")).alias("contacto"),
        F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string")).alias("fecha_inscripcion"), (k % 2 == 0).alias("activo"))
    return N.flatten_students(docs).withColumn("activo", F.col("activo").cast("string"))


J7_SQL = """SELECT 'P' || p_partkey AS id, p_name AS curso, p_brand AS departamento, CAST(p_size AS BIGINT) AS creditos, p_type AS profesor, 'Dr.' AS titulo_profesor,
  CASE WHEN p_partkey % 4 = 0 THEN 'Lunes' ELSE 'Lunes, Jueves' END AS dias,
  'Lunes ' || p_size || ':00-9:30' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '; Jueves 10:00-' || p_size || ':45' END AS horario,
  CAST(p_size AS BIGINT) * 2 AS cupo_maximo, CAST(p_size AS BIGINT) AS inscritos, 50.0 AS ocupacion_pct FROM part WHERE p_size > 0"""


@register("j7_flatten_courses", J7_SQL)
def j7_flatten_courses(spark, sf_dir):
    """Parts as nested course documents, flat again."""
    p = tbl(spark, sf_dir, "part").where("p_size > 0")
    size = F.col("p_size").cast("string")

    def slot(day, start, end):
        return F.struct(F.lit(day).alias("dia"), start.alias("hora_inicio"), end.alias("hora_fin"))

    monday = slot("Lunes", F.concat(size, F.lit(":00")), F.lit("9:30"))
    both = F.array(monday, slot("Jueves", F.lit("10:00"), F.concat(size, F.lit(":45"))))
    docs = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("_id"), F.struct(
        F.col("p_name").alias("nombre"), F.col("p_size").cast("long").alias("creditos"), F.col("p_brand").alias("departamento")).alias("info"),
        F.struct(F.col("p_type").alias("nombre"), F.lit("Dr.").alias("titulo")).alias("profesor"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(monday)).otherwise(both).alias("horario"),
        (F.col("p_size").cast("long") * 2).alias("cupo_maximo"), F.col("p_size").cast("long").alias("inscritos"))
    return N.flatten_courses(docs)
