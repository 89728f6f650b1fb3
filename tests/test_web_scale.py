"""The page queries spread their parse, scan the parsed pages once, and broadcast nothing of a row per page."""

import pyarrow as pa
import pytest

import __spark_entry__ as E
from sparkeda.operators import html as H
from sparkeda.operators import web as W
from sparkeda.plans import q_pages

SF = "/root/testdata/sf0.001"
KEPT = {"h7_everything_customers", "h7_contacts_products_customers", "a12_quality_customers", "h7_everything", "a12_quality_report"}
LAZY = ["h1_headings_customers", "h6_table_summary_customers", "h6_table_cells_customers", "h8_emails_customers", "h11_products_customers",
        "h13_select_path_customers", "h14_repeated_items_customers", "h15_page_summary_customers", "h17_page_kind_customers",
        "g1_link_edges_customers", "g3_next_page_customers", "g3_next_page_steps_customers",
        "h8_emails_pages", "h11_products", "h13_select_path", "h15_page_summary", "g3_next_page", "h0_tag_counts"]


def test_customer_pages_are_spread(spark, tmp_path):
    """One file of customers does not make one task, and more of them make more tasks."""
    at_least = spark.sparkContext.defaultParallelism * 2
    assert q_pages.customer_pages(spark, SF).rdd.getNumPartitions() >= at_least
    many = spark.range(0, q_pages.PAGES_PER_TASK * (at_least + 3), 1, 1).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "'s' AS c_mktsegment")
    many.write.parquet(str(tmp_path / "customer.parquet"))
    assert q_pages.customer_pages(spark, str(tmp_path)).rdd.getNumPartitions() == at_least + 3


@pytest.mark.parametrize("name", LAZY)
def test_one_parse_and_no_broadcast(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("MapInArrow") == 1 and "InMemoryTableScan" not in plan and "Broadcast" not in plan


def test_parse_returns_what_is_asked_for(spark):
    page = '<title>t</title><p>a<b>b</b></p><a href="/x">l</a><!-- c -->'
    pages = spark.createDataFrame([(1, "https://h.example.com/", page)], "page_id long, url string, html string")
    whole = H.parse_pages(pages)
    part = H.parse_pages(pages, **W.READS["links"])
    assert part.columns == ["page_id", "url", "node_id", "kind", "tag", "attrs", "full_text"]
    assert part.collect() == whole.where("tag = 'a'").select(part.columns).collect()
    with pytest.raises(ValueError, match="no such columns"):
        H.parse_pages(pages, columns=["tags"])


def test_batches_end_by_the_html_they_come_from():
    """Long pages leave in batches of their own, a few pages are read at a time."""
    html = ["<p>" + "x" * 1000 + "</p>"] * 50
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(50)), "url": ["u"] * 50, "html": html})
    got = list(H._parse_batches([batch], False, chars_per_batch=5000, pages_per_slice=7))
    assert max(b.num_rows for b in got) <= 3 * 7 and sum(b.num_rows for b in got) == 150


def test_items_by_a_path_and_items_that_hold_nothing(spark):
    """An item of two steps, nested items, and one in which no field is found."""
    page = ('<div class="x"><article><a href="1">one</a><article><a href="2">two</a></article></article></div>'
            '<article><a href="3">three</a></article><div class="x"><article>none</article></div>')
    el = H.parse_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    got = W.repeated_items(el, [W.Step(tag="div", classes=("x",)), W.Step(tag="article")], {
        "first": W.Field((W.Step(tag="a"),), "href"), "last": W.Field((W.Step(tag="a"),), None, "", last=True)}).orderBy("item_id").collect()
    assert [(r.first, r["last"]) for r in got] == [("1", "two"), ("2", "two"), (None, "")]
    three = W.match_path(el, [W.Step(tag="div"), W.Step(tag="article", axis="child"), W.Step(tag="a", axis="child")])
    assert three.count() == 1
    assert W.match_path(el, [W.Step(tag="div"), W.Step(tag="article"), W.Step(tag="a")]).count() == 2
