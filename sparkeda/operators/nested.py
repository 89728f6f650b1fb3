"""Nested data and JSON payloads.

Payloads are JSON text in a column.  Records are located with built-in JSON /
VARIANT expressions row by row; the record schema is inferred by one
aggregate (``schema_of_variant_agg``) whose result is a schema string, so no
payload ever travels to the driver and no RDD is needed.
"""

from __future__ import annotations

import json
import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _json_path(path: str) -> str:
    parts = [p for p in path.split(".") if p]
    return "$" + "".join(f".{p}" if "'" in p else f"['{p}']" for p in parts)


# --------------------------------------------------------------------------- J1
def parse_payloads(df: DataFrame, body: str = "body", keep=()) -> DataFrame:
    """The payloads parsed once: the columns ``keep``, ``body``, ``payload`` (VARIANT, null where the body is no JSON) and
    ``malformed``.  Persisted, since the path check, the schema and the records read it; ``unpersist`` releases it."""
    payload = F.try_parse_json(F.col(f"`{body}`"))
    d = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{body}`").alias("body"), payload.alias("payload"))
    return d.withColumn("malformed", F.col("body").isNotNull() & F.col("payload").isNull()).persist(StorageLevel.MEMORY_AND_DISK)


def _at(path: str | None) -> Column:
    return F.variant_get(F.col("payload"), _json_path(path), "variant") if path else F.col("payload")


def _missing(path: str) -> Column:
    node = _at(path)
    return F.col("body").isNotNull() & (node.isNull() | F.is_variant_null(node))


def _elements(node: Column) -> Column:
    """The records of a node; a payload that is no JSON or lacks the node has none."""
    return F.when(F.schema_of_variant(node).startswith("ARRAY"), F.variant_get(node, "$", "array<variant>")) \
        .when(node.isNotNull(), F.array(node))


def _check_path(parsed: DataFrame, path: str | None, extra_aggs=(), strict: bool = True):
    """One aggregate over parsed payloads: how many lack each key prefix, are malformed, and any extra aggregates.  A missing key is an error in
    any payload if ``strict``, else only if no payload has it."""
    keys = [p for p in (path or "").split(".") if p]
    checks = [F.count_if(_missing(".".join(keys[:i + 1]))).alias(f"m{i}") for i in range(len(keys))]
    lacks = ~F.col("malformed") & _missing(path) if path else F.lit(False)
    row = parsed.agg(*checks, F.count("body").alias("_bodies"), F.count_if("malformed").alias("malformed"),
                     F.count_if(lacks).alias("without_path"), *extra_aggs).first()
    for i, k in enumerate(keys):
        if row[f"m{i}"] and (strict or row[f"m{i}"] == row["_bodies"]):
            raise KeyError(f"path '{path}' does not exist in the JSON (failed at key '{k}')")
    return row


def bad_payloads(df: DataFrame, body: str = "body", path: str | None = None, keep=()) -> DataFrame:
    """The payloads without records: ``keep``, ``body`` and ``reason`` (``malformed`` or, with a path, ``without_path``)."""
    reason = F.when(F.col("malformed"), "malformed").when(_missing(path) if path else F.lit(False), "without_path")
    parsed = df if "payload" in df.columns and "malformed" in df.columns else parse_payloads(df, body, keep)
    return parsed.select(*[F.col(f"`{k}`") for k in keep], "body", reason.alias("reason")).where("reason IS NOT NULL")


def records_at(df: DataFrame, path: str, body: str = "body", keep=(), checked: bool = False, strict: bool = True) -> DataFrame:
    """Descend the dotted ``path`` in each payload and emit one row per record
    (column ``record``, VARIANT).  A key missing from any payload is an error
    naming that key (checked in one aggregate pass); without ``strict`` only one that no payload has,
    and payloads without records are listed by ``bad_payloads``.  ``df`` may be the result of ``parse_payloads``."""
    parsed = df if "payload" in df.columns and "malformed" in df.columns else parse_payloads(df, body, keep)
    if not checked:
        _check_path(parsed, path, strict=strict)
    return parsed.select(*keep, F.explode(_elements(_at(path))).alias("record"))


# --------------------------------------------------------------------------- J2
def _first_list() -> Column:
    """The first key of an object, in document order, that holds a list."""
    held = F.variant_get("payload", "$", "map<string,variant>")
    return F.try_element_at(F.filter(F.json_object_keys("body"), lambda k: F.coalesce(
        F.schema_of_variant(F.try_element_at(held, k)).startswith("ARRAY"), F.lit(False))), F.lit(1))


def detect_records(df: DataFrame, body: str = "body", keep=()) -> DataFrame:
    """A top-level array gives its elements; an object gives the elements of its
    first list-valued key in document order, else the object itself.  Malformed payloads have no records.
    ``df`` may be the result of ``parse_payloads``."""
    parsed = df if "payload" in df.columns and "malformed" in df.columns else parse_payloads(df, body, keep)
    kind, key = F.schema_of_variant("payload"), _first_list()
    held = F.try_element_at(F.variant_get("payload", "$", "map<string,variant>"), key)
    elems = (F.when(F.col("payload").isNull(), F.lit(None))
             .when(kind.startswith("ARRAY"), F.variant_get("payload", "$", "array<variant>"))
             .when(kind.startswith("OBJECT") & key.isNotNull(), F.variant_get(held, "$", "array<variant>"))
             .otherwise(F.array("payload")))
    return parsed.select(*keep, F.explode(elems).alias("record"))


def require_records(df: DataFrame) -> DataFrame:
    """Raise when there is no record at all (one tiny job)."""
    if df.limit(1).count() == 0:
        raise ValueError("the payloads hold no records (empty list)")
    return df


# --------------------------------------------------------------------------- J3
_DEC = re.compile(r"DECIMAL\(\d+,\s*[1-9]\d*\)")  # with a fraction; whole numbers of any size stay exact


def record_schema(records: DataFrame, record: str = "record") -> str:
    """Merged schema of all records as DDL (numbers with a fraction -> DOUBLE)."""
    s = records.agg(F.schema_of_variant_agg(F.col(record))).first()[0]
    if s is None:
        return "STRUCT<>"
    s = _DEC.sub("DOUBLE", s).replace("OBJECT<", "STRUCT<")
    return s


def records_to_struct(records: DataFrame, record: str = "record", keep=(), schema: str | None = None) -> DataFrame:
    schema = schema or record_schema(records, record)
    if not schema.startswith("STRUCT<"):
        # scalar records: one column named "value"
        return records.select(*keep, F.variant_get(F.col(record), "$", schema).alias("value"))
    return records.select(*keep, F.variant_get(F.col(record), "$", schema).alias("_r")).select(*keep, "_r.*")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects become ``a.b.c`` columns; arrays stay as they are."""
    cols = []

    def walk(prefix: list[str], dt, expr: Column):
        if isinstance(dt, T.StructType) and dt.fields:
            for f in dt.fields:
                walk(prefix + [f.name], f.dataType, expr.getField(f.name))
        else:
            cols.append(expr.alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], f.dataType, F.col(f"`{f.name}`"))
    return df.select(*cols)


# --------------------------------------------------------------------------- J4/J5
def _to_text(dt) -> callable:
    def conv(x: Column) -> Column:
        if isinstance(dt, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(x)
        return x.cast("string")
    return conv


def join_arrays(df: DataFrame, cols: list[str] | None = None, empty_as_null: bool = True) -> DataFrame:
    """Array cells -> ``"a, b"`` text.  An empty array gives NULL (or ``""``)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    exprs = {}
    for c in cols:
        et = df.schema[c].dataType.elementType
        joined = F.array_join(F.transform(F.col(f"`{c}`"), _to_text(et)), ", ", "None")
        exprs[c] = F.when(F.size(F.col(f"`{c}`")) == 0, F.lit(None if empty_as_null else "")).otherwise(joined)
    return df.withColumns(exprs) if exprs else df


def join_maps(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Object cells (map or struct) -> ``"k=v, k=v"``; empty -> NULL."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.StructType))]
    exprs = {}
    for c in cols:
        dt = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(dt, T.MapType):
            conv = _to_text(dt.valueType)
            text = F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(
                e.getField("key").cast("string"), F.lit("="), F.coalesce(conv(e.getField("value")), F.lit("None")))), ", ")
            exprs[c] = F.when(F.size(col) == 0, F.lit(None)).otherwise(text)
        else:
            parts = [F.concat(F.lit(f.name + "="), F.coalesce(_to_text(f.dataType)(col.getField(f.name)), F.lit("None")))
                     for f in dt.fields]
            exprs[c] = F.when(col.isNull(), F.lit(None)).otherwise(
                F.concat_ws(", ", *parts) if parts else F.lit(None))
    return df.withColumns(exprs) if exprs else df


def flatten_complex_cells(df: DataFrame, empty_as_null: bool = True) -> DataFrame:
    """J4 + J5 over every array / map / struct column (so value counts can hash them)."""
    return join_maps(join_arrays(df, empty_as_null=empty_as_null))


def _first_record(path: str | None) -> Column:
    """The first record of a parsed payload."""
    node = _at(path)
    if path is None:
        held = F.try_element_at(F.variant_get("payload", "$", "map<string,variant>"), _first_list())
        node = F.when(F.schema_of_variant("payload").startswith("OBJECT") & held.isNotNull(), held).otherwise(F.col("payload"))
    return F.when(F.schema_of_variant(node).startswith("ARRAY"), F.try_variant_get(node, "$[0]", "variant")).otherwise(node)


def _widest(path: str | None) -> Column:
    """The body whose first record has the most keys (ties: the greatest text), as an aggregate."""
    keys = F.size(F.map_keys(F.try_variant_get(_first_record(path), "$", "map<string,variant>")))
    return F.max_by("body", F.when(~F.col("malformed"), F.struct(F.coalesce(keys, F.lit(0)), F.col("body"))))


def _record_in(body: str | None, path: str | None):
    """The first record of one payload, as written."""
    try:
        obj = json.loads(body or "")
        for k in [p for p in (path or "").split(".") if p]:
            obj = obj[k]
        if path is None and isinstance(obj, dict):
            obj = next((v for v in obj.values() if isinstance(v, list)), obj)
        return obj[0] if isinstance(obj, list) else obj
    except (ValueError, KeyError, IndexError, TypeError):
        return None


def _doc_order(obj, sep: str = ".") -> list[str]:
    """Flattened column names of one record in document order."""
    out: list[str] = []

    def walk(prefix, v):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                walk(prefix + [k], x)
        else:
            out.append(sep.join(prefix))

    if isinstance(obj, dict):
        for k, v in obj.items():
            walk([k], v)
    return out


def payloads_to_table(df: DataFrame, body: str = "body", path: str | None = None, keep=(), check: bool = False,
                      document_order: bool = True, strict: bool = True, counts: dict | None = None) -> DataFrame:
    """J1/J2 -> J3 -> J4/J5: payload column to a flat table of records.

    Payloads are parsed once.  With a ``path`` the key check and the record schema come from one
    aggregate over the payloads (the merged schema of the array nodes).
    Columns follow the key order of a record as written (``document_order``;
    keys missing from that record follow alphabetically).  ``counts`` takes the numbers of ``malformed`` payloads and those ``without_path``."""
    schema, parsed = None, df if "payload" in df.columns and "malformed" in df.columns else parse_payloads(df, body, keep)
    more = [_widest(path).alias("_widest")] if document_order else []
    row = _check_path(parsed, path, [F.schema_of_variant_agg(_at(path)).alias("_schema"), *more], strict)
    if counts is not None:
        counts.update({k: row[k] for k in ("malformed", "without_path")})
    s = row["_schema"] or ""
    if path and s.startswith("ARRAY<") and s.endswith(">"):
        inner = s[len("ARRAY<"):-1]
        if inner.startswith("OBJECT<"):
            schema = _DEC.sub("DOUBLE", inner).replace("OBJECT<", "STRUCT<")
    recs = records_at(parsed, path, body, keep, checked=True) if path else detect_records(parsed, body, keep)
    if check:
        require_records(recs)
    out = flatten_complex_cells(flatten(records_to_struct(recs, "record", keep, schema=schema)))
    if document_order:
        order = _doc_order(_record_in(row["_widest"], path))
        rest = [c for c in out.columns if c not in keep]
        cols = list(keep) + [c for c in order if c in rest] + [c for c in rest if c not in order]
        out = out.select(*[F.col(f"`{c}`") for c in cols])
    return out


# --------------------------------------------------------------------------- J6/J7
def flatten_students(docs: DataFrame) -> DataFrame:
    """The 15-column student table from nested student documents."""
    mats = F.col("academico.materias_cursadas")
    return docs.select(
        F.col("_id").alias("id"), F.col("datos_personales.nombre").alias("nombre"),
        F.col("datos_personales.apellido").alias("apellido"), F.col("datos_personales.edad").alias("edad"),
        F.col("datos_personales.correo").alias("correo"), F.col("academico.carrera").alias("carrera"),
        F.col("academico.semestre").alias("semestre"), F.col("academico.promedio").alias("promedio"),
        F.size(mats).alias("num_materias"), F.array_join(mats, ", ").alias("materias"),
        F.col("contacto.telefono").alias("telefono"), F.col("contacto.direccion.ciudad").alias("ciudad"),
        F.col("contacto.direccion.codigo_postal").alias("codigo_postal"),
        F.col("fecha_inscripcion").alias("fecha_inscripcion"), F.col("activo").alias("activo"))


def flatten_courses(docs: DataFrame) -> DataFrame:
    """The 11-column course table; joined days, ``dia ini-fin`` schedule, occupancy %."""
    h = F.col("horario")
    return docs.select(
        F.col("_id").alias("id"), F.col("info.nombre").alias("curso"),
        F.col("info.departamento").alias("departamento"), F.col("info.creditos").alias("creditos"),
        F.col("profesor.nombre").alias("profesor"), F.col("profesor.titulo").alias("titulo_profesor"),
        F.array_join(F.transform(h, lambda x: x["dia"]), ", ").alias("dias"),
        F.array_join(F.transform(h, lambda x: F.concat(x["dia"], F.lit(" "), x["hora_inicio"], F.lit("-"),
                                                       x["hora_fin"])), "; ").alias("horario"),
        F.col("cupo_maximo"), F.col("inscritos"),
        F.round(F.try_divide(F.col("inscritos").cast("double"), F.col("cupo_maximo")) * 100, 1).alias("ocupacion_pct"))
