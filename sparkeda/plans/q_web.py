"""Registered page / text extraction and link-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkeda.functions import text as X
from sparkeda.operators import graph as G
from sparkeda.operators import web as W
from sparkeda.operators.html import element_table, parse_pages
from sparkeda.plans.catalog import register, tbl
from sparkeda.plans.q_clean import lit


def _el(spark, sf_dir, reads, reused=False):
    """What is read of the element table; persisted when the plan reads it more than once."""
    return element_table(tbl(spark, sf_dir, "pages"), persist=reused, **reads)


@register("h0_parse_pages")
def h0_parse_pages(spark, sf_dir):
    return parse_pages(tbl(spark, sf_dir, "pages")).drop("attrs")


# every extractor reads the element table once, but for h7's two scans (nodes by themselves, tables)
for _name, _fn, _reads in [("h1_headings", W.headings, "headings"), ("h2_paragraphs", W.paragraphs, "paragraphs"),
                           ("h3_visible_text", W.visible_text, "text"), ("h4_links", W.links, "links"), ("h5_images", W.images, "images"),
                           ("h6_table_summary", W.table_summary, "tables"), ("h6_table_cells", W.table_cells, "cells"),
                           ("h8_emails_pages", W.emails, "emails"), ("h9_phones_pages", W.phones, "phones"),
                           ("h14_repeated_items", W.trending_items, "trending"), ("h15_page_summary", W.page_summary, "summary"),
                           ("h16_headings_table", W.headings_table, "headings"), ("h16_paragraphs_table", W.paragraphs_table, "paragraphs"),
                           ("g1_link_edges", G.link_edges, "edges")]:
    register(_name)((lambda f, r: (lambda spark, sf_dir: f(_el(spark, sf_dir, W.READS[r]))))(_fn, _reads))


@register("h7_everything")
def h7_everything(spark, sf_dir):
    return W.everything(_el(spark, sf_dir, W.reads(*W.EVERYTHING), reused=True))


@register("g3_next_page")
def g3_next_page(spark, sf_dir):
    return G.next_page(_el(spark, sf_dir, W.READS["next"]))


@register("h11_products")
def h11_products(spark, sf_dir):
    return W.products(_el(spark, sf_dir, W.READS["products"]))


@register("h12_by_tags")
def h12_by_tags(spark, sf_dir):
    tags = ["div", "li"]
    return W.by_tags(_el(spark, sf_dir, W.tags_read(tags)), tags, class_="ad")


@register("h13_select_path")
def h13_select_path(spark, sf_dir):
    steps = [W.Step(tag="article"), W.Step(tag="p", axis="child")]
    reads = W.steps_read(steps, "full_text", "source") | {"source_chars": 300}
    return W.select_path(_el(spark, sf_dir, reads), steps, with_source=True)


@register("h17_page_kind")
def h17_page_kind(spark, sf_dir):
    pages = tbl(spark, sf_dir, "pages")
    return W.page_kind(pages, element_table(pages, persist=False, **W.READS["kind"]))


# SQL-checkable parts -----------------------------------------------------------
H8_SQL = (f"SELECT DISTINCT doc_id, 'correo' AS tipo, unnest(regexp_extract_all(text, {lit(W.EMAIL_RE)})) "
          f"AS contenido FROM documents")


@register("h8_emails_documents", H8_SQL)
def h8_emails_documents(spark, sf_dir):
    return W.emails_in_text(tbl(spark, sf_dir, "documents"), "text")


H9_SQL = (f"SELECT doc_id, 'telefono' AS tipo, contenido FROM (SELECT DISTINCT doc_id, "
          f"unnest(regexp_extract_all(text, {lit(W.PHONE_RE)})) AS contenido FROM documents) "
          f"WHERE length(contenido) >= 7")


@register("h9_phones_documents", H9_SQL)
def h9_phones_documents(spark, sf_dir):
    return W.phones_in_text(tbl(spark, sf_dir, "documents"), "text")


H10_SQL = "SELECT page_id, 'red_social' AS tipo, red, 'https://' || regexp_replace(m, " + lit(W.SOCIAL_TRAIL) + \
    ", '') AS url FROM (" + " UNION ".join(
        f"SELECT DISTINCT page_id, '{net}' AS red, unnest(regexp_extract_all(html, {lit(rx)})) AS m FROM pages"
        for net, rx in W.SOCIAL_RE) + ")"


@register("h10_social_links", H10_SQL)
def h10_social_links(spark, sf_dir):
    return W.social_links(tbl(spark, sf_dir, "pages"))


H17_SQL = "SELECT page_id, (" + " + ".join(
    f"CAST(contains(lower(html), {lit(m)}) AS INTEGER)" for m in W.JS_MARKERS) + ") AS markers FROM pages"


@register("h17_js_markers", H17_SQL)
def h17_js_markers(spark, sf_dir):
    return tbl(spark, sf_dir, "pages").select("page_id", W.marker_count().alias("markers"))


_FIX = ("CASE WHEN url IS NULL OR url = '' THEN url WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') "
        "THEN url ELSE 'https://' || url END")
H18_SQL = (f"SELECT page_id, {_FIX} AS fixed_url, CASE WHEN url IS NULL OR url = '' THEN false ELSE "
           f"coalesce(regexp_matches({_FIX}, {lit(X.URL_PATTERN)}), false) END AS valid, "
           f"CASE WHEN url IS NULL OR url = '' THEN false ELSE "
           f"coalesce(regexp_matches({_FIX}, {lit(X.URL_PATTERN_NO_PORT)}), false) END AS valid_no_port FROM pages")


@register("h18_valid_url", H18_SQL)
def h18_valid_url(spark, sf_dir):
    p = tbl(spark, sf_dir, "pages")
    return p.select("page_id", X.fixed_url("url").alias("fixed_url"), X.valid_url("url").alias("valid"),
                    X.valid_url("url", allow_port=False).alias("valid_no_port"))


H19_SQL = (f"SELECT page_id, lower(regexp_extract(url, {lit(X.SCHEME_RE)}, 1)) || '://' || "
           f"regexp_extract(url, {lit(X.NETLOC_RE)}, 1) AS origin FROM pages")


@register("h19_origin", H19_SQL)
def h19_origin(spark, sf_dir):
    return tbl(spark, sf_dir, "pages").select("page_id", X.origin("url").alias("origin"))


# link graph -----------------------------------------------------------------------
def _host_seeds(pages):
    """One seed per host: its lowest page id."""
    return (pages.groupBy(X.url_netloc("url").alias("host")).agg(F.min("page_id").alias("page_id"))
            .join(pages, "page_id").select("url"))


@register("g2_reachable")
def g2_reachable(spark, sf_dir):
    pages = tbl(spark, sf_dir, "pages")
    el = element_table(pages, persist=False, **W.READS["edges"])
    return G.reachable(pages, G.link_edges(el), _host_seeds(pages), depth=5)


@register("g3_page_chain")
def g3_page_chain(spark, sf_dir):
    pages = tbl(spark, sf_dir, "pages")
    return G.page_chain(pages, G.next_page(element_table(pages, persist=False, **W.READS["next"])), _host_seeds(pages), max_pages=10)


@register("a12_quality_report")
def a12_quality_report(spark, sf_dir):
    from sparkeda.operators.profile import quality_report
    recs = W.everything(_el(spark, sf_dir, W.reads(*W.EVERYTHING), reused=True))
    return quality_report(recs.select("tipo", "contenido", "src", "texto", "href"))


@register("s12_read_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS bytes FROM pages")
def s12_read_pages(spark, sf_dir):
    import os
    from sparkeda.sources.files import read_pages
    return read_pages(spark, os.path.join(sf_dir, "pages.parquet")).select("page_id", "url", F.length("html").alias("bytes"))


# Parser cross-check: element counts per page vs start tags counted in the raw html.
TAG_COUNT_SQL = """SELECT page_id,
  CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>/]')) AS BIGINT) AS n_h1,
  CAST(len(regexp_extract_all(html, '(?i)<p[\\s>/]')) AS BIGINT) AS n_p,
  CAST(len(regexp_extract_all(html, '(?i)<li[\\s>/]')) AS BIGINT) AS n_li,
  CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=')) AS BIGINT) AS n_links,
  CAST(len(regexp_extract_all(html, '(?i)<script[\\s>/]')) AS BIGINT) AS n_script
FROM pages"""


@register("h0_tag_counts", TAG_COUNT_SQL)
def h0_tag_counts(spark, sf_dir):
    pages = tbl(spark, sf_dir, "pages")
    e = W.elements(parse_pages(pages, keep_strings=False, text_tags=[], columns=["tag", "attrs"]))
    counts = e.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "h1").alias("n_h1"), F.count_if(F.col("tag") == "p").alias("n_p"),
        F.count_if(F.col("tag") == "li").alias("n_li"),
        F.count_if((F.col("tag") == "a") & W.has_attr("href")).alias("n_links"),
        F.count_if(F.col("tag") == "script").alias("n_script"))
    return pages.select("page_id").join(counts.hint("merge"), "page_id", "left").na.fill(0)
