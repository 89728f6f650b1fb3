"""Registered cleaning / null / scaling queries (T1-T11, N1-N6) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.functions import text as X
from sparkeda.operators import clean as C
from sparkeda.plans.catalog import register, round_doubles, tbl
from sparkeda.plans.q_profile import NULLY_SQL, nully_lineitem

WS = X.WS_CLASS


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQ = {  # SQL (DuckDB) forms of the column functions
    "tags": lambda c: f"regexp_replace({c}, {lit(X.TAG_PATTERN)}, '', 'g')",
    "spaces": lambda c: f"trim(regexp_replace({c}, {lit('[' + WS + ']+')}, ' ', 'g'))",
    "chars": lambda c: f"regexp_replace({c}, {lit('[^\\p{L}\\p{N}_' + WS + X.KEEP_PUNCT + ']')}, '', 'g')",
    "lower": lambda c: f"regexp_replace(lower({c}), {lit('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g')",
    "dates": lambda c: (f"regexp_replace(regexp_replace({c}, {lit(X.DATE_PATTERNS[0])}, '\\3-\\2-\\1', 'g'), "
                        f"{lit(X.DATE_PATTERNS[1])}, '\\3-\\2-\\1', 'g')"),
}


def sql_clean(c: str, options) -> str:
    for step in ("tags", "spaces", "chars", "lower", "dates"):
        if step in options:
            c = SQ[step](c)
    return c


# T1 (tag half with SQL; with entity unescape rows-only)
@register("t1_strip_tags", f"SELECT page_id, {SQ['tags']('html')} AS text FROM pages")
def t1_strip_tags(spark, sf_dir):
    return tbl(spark, sf_dir, "pages").select("page_id", X.strip_tags("html").alias("text"))


@register("t1_strip_html")
def t1_strip_html(spark, sf_dir):
    return tbl(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("text"))


@register("t2_squeeze_spaces", f"SELECT doc_id, {SQ['spaces']('text')} AS text FROM documents")
def t2_squeeze_spaces(spark, sf_dir):
    return tbl(spark, sf_dir, "documents").select("doc_id", X.squeeze_spaces("text").alias("text"))


@register("t3_drop_special_chars", f"SELECT doc_id, {SQ['chars']('text')} AS text FROM documents")
def t3_drop_special_chars(spark, sf_dir):
    return tbl(spark, sf_dir, "documents").select("doc_id", X.drop_special_chars("text").alias("text"))


@register("t4_lower_trim", f"SELECT conv_id, turn, {SQ['lower']('text')} AS text FROM conversations")
def t4_lower_trim(spark, sf_dir):
    return tbl(spark, sf_dir, "conversations").select("conv_id", "turn", X.lower_trim("text").alias("text"))


@register("t5_iso_dates", f"SELECT doc_id, {SQ['dates']('text')} AS text FROM documents")
def t5_iso_dates(spark, sf_dir):
    return tbl(spark, sf_dir, "documents").select("doc_id", X.iso_dates("text").alias("text"))


T6_OPTS = ("spaces", "chars", "lower", "dates")
T6_SQL = (f"SELECT doc_id, source AS tipo, {sql_clean('text', T6_OPTS)} AS contenido FROM documents "
          f"WHERE length({sql_clean('text', T6_OPTS)}) > 0")


def _doc_records(spark, sf_dir):
    return tbl(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tipo"),
                                                  F.col("text").alias("contenido"))


@register("t6_clean_records", T6_SQL)
def t6_clean_records(spark, sf_dir):
    return C.clean_records(_doc_records(spark, sf_dir), options=T6_OPTS)


T7_SQL = (f"SELECT DISTINCT lang, {sql_clean('text', T6_OPTS)} AS contenido FROM documents")


@register("t7_drop_duplicates", T7_SQL)
def t7_drop_duplicates(spark, sf_dir):
    d = tbl(spark, sf_dir, "documents").select("lang", F.col("text").alias("contenido"))
    return C.drop_duplicate_records(d.withColumn("contenido", C.clean_column(F.col("contenido"), T6_OPTS)))


T8_SQL = ("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text ELSE '' END AS contenido, "
          "CASE WHEN turn % 3 = 0 THEN text END AS texto FROM conversations "
          "WHERE length(CASE WHEN role = 'user' THEN text ELSE '' END) > 0 "
          "OR length(CASE WHEN turn % 3 = 0 THEN text END) > 0")


@register("t8_drop_empty_records", T8_SQL)
def t8_drop_empty_records(spark, sf_dir):
    cv = tbl(spark, sf_dir, "conversations")
    recs = cv.select("conv_id", "turn", "role",
                     F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("contenido"),
                     F.when(F.col("turn") % 3 == 0, F.col("text")).alias("texto"))
    return C.drop_empty_records(recs)


T9_SQL = (f"SELECT doc_id, CAST(length(text) AS INTEGER) AS length, "
          f"CAST(len(regexp_extract_all(text, {lit('[^' + WS + ']+')})) AS INTEGER) AS words FROM documents")


@register("t9_text_stats", T9_SQL)
def t9_text_stats(spark, sf_dir):
    d = tbl(spark, sf_dir, "documents")
    return d.select("doc_id", X.text_length("text").alias("length"), X.word_count("text").alias("words"))


T10_SQL = ("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' "
           "ELSE text END AS text FROM conversations")


@register("t10_truncate", T10_SQL)
def t10_truncate(spark, sf_dir):
    return tbl(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate("text", 200).alias("text"))


T11_SQL = "SELECT doc_id, source AS tipo, text AS contenido FROM documents ORDER BY doc_id LIMIT 50"


@register("t11_limit_records", T11_SQL)
def t11_limit_records(spark, sf_dir):
    return C.limit_records(_doc_records(spark, sf_dir), 50, order_by=("doc_id",))


# N1-N6 on the derived-null lineitem view
IMP_COLS = ["l_discount", "l_quantity"]


def _imp_sql(agg: str) -> str:
    return (f"WITH d AS ({NULLY_SQL}) SELECT l_orderkey, "
            + ", ".join(f"round(coalesce({c}, (SELECT {agg.format(c=c)} FROM d)), 4) AS {c}" for c in IMP_COLS)
            + ", l_returnflag, l_tax FROM d")


@register("n1_impute_mean", _imp_sql("avg({c})"))
def n1_impute_mean(spark, sf_dir):
    d = nully_lineitem(spark, sf_dir)
    return round_doubles(C.Imputer("mean", IMP_COLS + ["l_returnflag"]).fit_transform(d))


@register("n1_impute_median", _imp_sql("median({c})"))
def n1_impute_median(spark, sf_dir):
    d = nully_lineitem(spark, sf_dir)
    return round_doubles(C.Imputer("median", IMP_COLS).fit_transform(d))


MODE_SQL = (f"WITH d AS ({NULLY_SQL}), "
            "m AS (SELECT v FROM (SELECT l_returnflag AS v, count(*) AS n FROM d WHERE l_returnflag IS NOT NULL "
            "GROUP BY 1) ORDER BY n DESC, v LIMIT 1), "
            "q AS (SELECT v FROM (SELECT l_quantity AS v, count(*) AS n FROM d WHERE l_quantity IS NOT NULL "
            "GROUP BY 1) ORDER BY n DESC, v LIMIT 1) "
            "SELECT l_orderkey, l_discount, coalesce(l_quantity, (SELECT v FROM q)) AS l_quantity, "
            "coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag, l_tax FROM d")


@register("n1_impute_mode", MODE_SQL)
def n1_impute_mode(spark, sf_dir):
    d = nully_lineitem(spark, sf_dir)
    return C.Imputer("mode", ["l_quantity", "l_returnflag"]).fit_transform(d)


@register("n2_drop_nulls", f"WITH d AS ({NULLY_SQL}) SELECT * FROM d WHERE l_discount IS NOT NULL "
                           f"AND l_returnflag IS NOT NULL")
def n2_drop_nulls(spark, sf_dir):
    return C.drop_nulls(nully_lineitem(spark, sf_dir), ["l_discount", "l_returnflag"])


SCALE_COLS = ["l_orderkey", "l_discount", "l_quantity", "l_tax"]


def _scale_sql(kind: str) -> str:
    parts = []
    for c in SCALE_COLS:
        if kind == "z":
            parts.append(f"round(({c} - coalesce((SELECT avg({c}) FROM d), 0)) / "
                         f"coalesce(nullif((SELECT stddev_samp({c}) FROM d), 0), 1), 6) AS {c}")
        else:
            parts.append(f"round(({c} - coalesce((SELECT min({c}) FROM d), 0)) / "
                         f"coalesce(nullif((SELECT max({c}) - min({c}) FROM d), 0), 1), 6) AS {c}")
    return f"WITH d AS ({NULLY_SQL}) SELECT {', '.join(parts)}, l_returnflag FROM d"


@register("n3_zscore", _scale_sql("z"))
def n3_zscore(spark, sf_dir):
    return round_doubles(C.Scaler("zscore").fit_transform(nully_lineitem(spark, sf_dir)), 6)


@register("n4_minmax", _scale_sql("m"))
def n4_minmax(spark, sf_dir):
    return round_doubles(C.Scaler("minmax").fit_transform(nully_lineitem(spark, sf_dir)), 6)


N5_SQL = ("SELECT event_id, TRY_CAST(props AS DOUBLE) AS props_num, "
          "TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k_num, "
          "TRY_CAST(event_type AS DOUBLE) AS type_num FROM events")


@register("n5_to_numeric", N5_SQL)
def n5_to_numeric(spark, sf_dir):
    e = tbl(spark, sf_dir, "events")
    return e.select("event_id", X.to_numeric("props").alias("props_num"),
                    X.to_numeric(F.regexp_extract("props", "[0-9]+", 0)).alias("k_num"),
                    X.to_numeric("event_type").alias("type_num"))


N6_SQL = ("SELECT o_orderkey, o_totalprice, coalesce(CAST(o_totalprice >= (SELECT median(o_totalprice) "
          "FROM orders) AS INTEGER), 0) AS label FROM orders")


@register("n6_threshold_label", N6_SQL)
def n6_threshold_label(spark, sf_dir):
    o = tbl(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return C.threshold_label(o, "o_totalprice", name="label")
