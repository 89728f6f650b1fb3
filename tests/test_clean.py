"""Record cleaning (T1-T11) on small records."""

from sparkeda.functions import text as X
from sparkeda.operators import clean as C
from sparkeda.operators.profile import quality_report


def test_column_functions(spark):
    df = spark.createDataFrame([("  <b>Año&nbsp;nuevo</b>\t\n el 5/3/2024 y 07-11-1999 ¡Ñandú! ™ ",)], "t string")
    r = df.select(X.strip_html("t").alias("h"), X.squeeze_spaces("t").alias("s"), X.drop_special_chars("t").alias("c"),
                  X.lower_trim("t").alias("l"), X.iso_dates("t").alias("d"), X.word_count("t").alias("w"),
                  X.truncate("t", 5).alias("tr")).first()
    assert r.h == "  Año\xa0nuevo\t\n el 5/3/2024 y 07-11-1999 ¡Ñandú! ™ "
    assert r.s == "<b>Año&nbsp;nuevo</b> el 5/3/2024 y 07-11-1999 ¡Ñandú! ™"
    assert "™" not in r.c and "Ñandú" in r.c and "<" not in r.c
    assert r.l == "<b>año&nbsp;nuevo</b>\t\n el 5/3/2024 y 07-11-1999 ¡ñandú! ™"
    assert "2024-3-5" in r.d and "1999-11-07" in r.d
    assert r.w == 7 and r.tr == "  <b>..."


def test_clean_records_pipeline(spark):
    recs = spark.createDataFrame([
        ("parrafo", "<p>Hola&amp;  Mundo</p>", None, None),
        ("parrafo", "<p>hola&amp; mundo</p>", None, None),
        ("red_social", None, "facebook", "https://facebook.com/x"),
        ("link", "   ", "", None)], "tipo string, contenido string, red string, url string")
    out = C.clean_records(recs, options=("html", "spaces", "lower", "duplicates")).collect()
    assert [(r.tipo, r.contenido) for r in out] == [("parrafo", "hola& mundo")]
    kept = C.clean_records(recs, options=("spaces",), keep_kinds=("red_social",)).collect()
    assert {r.tipo for r in kept} == {"parrafo", "red_social"}
    lim = C.limit_records(recs.withColumn("page_id", recs.tipo), 2, order_by=("page_id",)).collect()
    assert [r.tipo for r in lim] == ["link", "parrafo"]


def test_quality_report(spark):
    recs = spark.createDataFrame([("imagen", None, ""), ("imagen", None, ""), ("parrafo", "x", None), ("parrafo", "", None)],
                                 "tipo string, contenido string, src string")
    r = {(x.metric, x.kind): x.value for x in quality_report(recs).collect()}
    assert r[("total", None)] == 4 and r[("duplicates", None)] == 1 and r[("empty_content", None)] == 3
    assert r[("images_without_src", None)] == 2 and r[("records_per_kind", "imagen")] == 2


def test_url_functions(spark):
    df = spark.createDataFrame([("example.com/a b",), ("http://x.example.org:8080/p?q=1#f",), ("",), ("ftp://h/x",)], "u string")
    r = df.select(X.fixed_url("u").alias("f"), X.valid_url("u").alias("v"), X.valid_url("u", allow_port=False).alias("v2"),
                  X.origin("u").alias("o")).collect()
    assert (r[0].f, r[0].v) == ("https://example.com/a b", False)
    assert (r[1].v, r[1].v2, r[1].o) == (True, False, "http://x.example.org:8080")
    assert (r[2].f, r[2].v) == ("", False)
    assert r[3].o == "ftp://h"


def test_quality_report_without_records_and_without_a_kind(spark):
    recs = spark.createDataFrame([(None, "x", 1), (None, "x", 1), ("total", "", 2)], "tipo string, contenido string, n int")
    assert sorted(map(tuple, quality_report(recs).collect()), key=str) == sorted([
        ("total", None, 3), ("empty_content", None, 1), ("duplicates", None, 1), ("images_without_src", None, 0),
        ("records_per_kind", None, 2), ("records_per_kind", "total", 1)], key=str)
    assert sorted(map(tuple, quality_report(recs.limit(0)).collect())) == [
        ("duplicates", None, 0), ("empty_content", None, 0), ("images_without_src", None, 0), ("total", None, 0)]


def test_quality_of_customer_pages_reads_every_column(spark, monkeypatch):
    """Records that differ in any column are no duplicates, and an image without src is one."""
    from sparkeda.plans import q_pages

    monkeypatch.setattr(q_pages, "customer_pages", lambda spark, sf_dir: spark.createDataFrame([
        (1, "https://h.example.com/", '<h1>a</h1><h2>a</h2><a href="/x">l</a><a href="/y">l</a><a href="/x">l</a><img alt="z"><img src="/i.png">')],
        "page_id long, url string, html string"))
    r = {(x.metric, x.kind): x.value for x in q_pages.a12_quality_customers(spark, "").collect()}
    assert r[("total", None)] == 7 and r[("duplicates", None)] == 1 and r[("images_without_src", None)] == 1
