"""Link graphs over landed pages.

Crawling is re-aimed at a table of landed pages: the link graph is an edge
table, reachability is breadth-first search as an iterative join (one join +
anti-join per level, the new level written by a reliable checkpoint), and
pagination chains double their links, so long ones take few rounds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from sparkeda.functions import text as X
from sparkeda.operators.web import Step, _matched, _one_page, attr, elements, has_attr
from sparkeda.session import checkpoint_dir


def _url_parts(c: Column):
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    frag = F.regexp_extract(c, r"#(.*)$", 1)
    return path, query, frag


def normalize_url(c: Column) -> Column:
    """``scheme://netloc/path`` plus ``?query`` when present (fragment dropped)."""
    path, query, _ = _url_parts(c)
    base = F.concat(X.url_scheme(c), F.lit("://"), X.url_netloc(c), path)
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


# ------------------------------------------------------------------------- G1
def link_edges(el: DataFrame) -> DataFrame:
    """G1: same-host links without fragment, normalized, distinct:
    (page_id, src_url, dst_url, link_pos)  -- link_pos is the first link's node id."""
    a = elements(el, ["a"]).where(has_attr("href"))
    full = X.url_join(F.col("url"), attr("href"))
    e = a.select("page_id", F.col("url").alias("src_url"), "node_id", full.alias("h"))
    _, _, frag = _url_parts(F.col("h"))
    e = e.where((X.url_netloc("h") == X.url_netloc("src_url")) & (frag == ""))
    return (e.select("page_id", "src_url", normalize_url(F.col("h")).alias("dst_url"), "node_id")
            .groupBy("page_id", "src_url", "dst_url").agg(F.min("node_id").alias("link_pos")))


# ------------------------------------------------------------------------- G2
def reachable(pages: DataFrame, edges: DataFrame, seeds, depth: int = 1, max_pages: int | None = None) -> DataFrame:
    """Breadth-first reach from ``seeds`` (list of URLs or a DataFrame with
    ``url``) through landed pages, up to ``depth`` levels; first visit wins.

    Output: page_id, url, level, order (array key: discovery order).  With
    ``max_pages`` only the first pages in visiting order are kept (the crawl
    limit is the feature), via a distributed top-k."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    pg = pages.select("page_id", "url").hint("merge")  # sizes guessed before pages are parsed must not make these broadcasts
    if isinstance(seeds, DataFrame):
        s = seeds.select("url").withColumn("i", F.monotonically_increasing_id())
    else:
        s = spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, i long")
    visited = (s.join(pg, "url").groupBy("page_id", "url").agg(F.min("i").alias("i"))
               .select("page_id", "url", F.lit(0).alias("level"), F.array("i").alias("order")))
    frontier = visited = visited.checkpoint(eager=True)
    kept = edges.select("page_id", "dst_url", "link_pos").persist(StorageLevel.MEMORY_AND_DISK)  # found once, read by every level
    ed = kept.hint("merge")
    for lvl in range(1, depth + 1):
        step = (frontier.join(ed, "page_id")
                .select(F.col("dst_url").alias("url"), F.concat("order", F.array(F.col("link_pos").cast("long"))).alias("order"))
                .join(pg, "url")
                .groupBy("page_id", "url").agg(F.min("order").alias("order"))
                .join(visited.select("page_id"), "page_id", "left_anti")
                .select("page_id", "url", F.lit(lvl).alias("level"), "order"))
        frontier = step.checkpoint(eager=True)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)  # every level is written once, by its own checkpoint
    kept.unpersist()
    if max_pages is not None:
        return visited.orderBy("level", "order").limit(max_pages)
    return visited


# ------------------------------------------------------------------------- G3
# Next-page link tests by priority (selectors, then link texts).
NEXT_TEXTS_CONTAINS = ["Next", "Siguiente", "»", "→"]
NEXT_LINK_TEXTS = ["Next", "Siguiente", "›", "»", "→"]


def next_page_candidates(el: DataFrame) -> DataFrame:
    """(page_id, url, prio, node_id, href) for every ``a`` matching a priority test."""
    # ':contains' reads the raw text when the element table carries it (with_raw_text=True)
    from pyspark.sql import Window
    is_link, none = F.col("tag") == "a", F.array().cast("array<struct<pos:int,anc:int>>")
    in_next = F.array_contains("classes", "next")
    says = F.struct(F.array_contains("classes", "pagination").alias("pagination"), F.array_contains("classes", "pager").alias("pager"), in_next.alias("next"),
                    ((F.col("tag") == "li") & in_next).alias("li_next"), F.coalesce(attr("class").contains("next"), F.lit(False)).alias("raw_next"))
    marked = F.col("says.pagination") | F.col("says.pager") | F.col("says.next") | F.col("says.raw_next")
    link = F.struct("classes", attr("href").alias("href"), attr("rel").alias("rel"), attr("aria-label").alias("aria"), "is_last",
                    F.coalesce("raw_text", "full_text").alias("text"), "own_string")
    # links, and the elements whose class says something of the links below them: all of a page in one partition
    rows = _one_page(elements(el).select("page_id", "url", "node_id", F.when(is_link, F.col("path")).alias("path"), says.alias("says"),
                                         F.when(is_link, link).alias("a")).where(F.col("path").isNotNull() | marked))
    above = F.transform("path", lambda a, i: F.struct(i.alias("pos"), a.alias("anc")))
    keys = F.concat(F.when(marked, F.array(F.struct(F.lit(-1).alias("pos"), F.col("node_id").alias("anc")))).otherwise(none), F.coalesce(above, none))
    j = rows.withColumn("key", F.explode(keys)).drop("path")
    j = j.withColumn("of", F.max(F.when(F.col("key.pos") < 0, F.col("says"))).over(Window.partitionBy("page_id", "key.anc"))).where("key.pos >= 0")
    pos = F.col("key.pos")
    agg = j.groupBy("page_id", "url", "node_id").agg(
        F.first("a").alias("a"), F.max(F.col("of.pagination").cast("int")).alias("in_pagination"), F.min(F.when(F.col("of.pager"), pos)).alias("pager_pos"),
        F.max(F.when(F.col("of.next"), pos)).alias("next_pos"), F.max(F.col("of.li_next").cast("int")).alias("in_li_next"),
        F.max(F.col("of.raw_next").cast("int")).alias("in_class_next")).select("*", "a.*")
    cls = F.col("classes")
    tests = [
        F.array_contains(cls, "next"),
        F.array_contains(cls, "next-page"),
        F.col("rel") == "next",
        (F.col("in_pagination") == 1) & F.col("is_last"),
        F.col("pager_pos").isNotNull() & F.col("next_pos").isNotNull() & (F.col("pager_pos") < F.col("next_pos")),
        F.col("aria") == "Next",
        F.col("aria") == "Siguiente",
        F.col("in_li_next") == 1,
        F.col("next_pos").isNotNull(),
        F.col("in_class_next") == 1,
    ] + [F.col("text").contains(t) for t in NEXT_TEXTS_CONTAINS] \
      + [F.lower(F.col("own_string")).contains(t.lower()) for t in NEXT_LINK_TEXTS]
    prios = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(i)) for i, t in enumerate(tests)]))
    return agg.select("page_id", "url", "node_id", "href", F.explode(prios).alias("prio"))


def next_page(el: DataFrame, steps: list[Step] | None = None) -> DataFrame:
    """Per page the next-page URL (``prio``: the number of the test that found it).

    Without ``steps``: for each test in priority order its first match in document order counts; it must carry an
    href that resolves to a different URL, else the next test is tried.  With ``steps``, a
    path of one's own: the first match of the path, if it carries an href that resolves."""
    if steps is not None:
        hits = _matched(el, steps, ("url", "attrs"))
        first = hits.groupBy("page_id", "url").agg(F.min(F.struct("node_id", attr("href").alias("href"))).alias("f"))
        return (first.where(F.coalesce(F.col("f.href"), F.lit("")) != "")
                .select("page_id", "url", X.url_join(F.col("url"), F.col("f.href")).alias("next_url"), F.lit(0).alias("prio"))
                .where("next_url IS NOT NULL"))
    c = next_page_candidates(el)
    first = c.groupBy("page_id", "url", "prio").agg(F.min(F.struct("node_id", "href")).alias("f"))
    nxt = X.url_join(F.col("url"), F.col("f.href"))
    ok = first.where(F.col("f.href").isNotNull()).select("page_id", "url", "prio", nxt.alias("next_url")) \
        .where(F.col("next_url") != F.col("url"))
    return ok.groupBy("page_id", "url").agg(F.min(F.struct("prio", "next_url")).alias("b")) \
        .select("page_id", "url", F.col("b.next_url").alias("next_url"), F.col("b.prio").alias("prio"))


def page_chain(pages: DataFrame, nexts: DataFrame, start_urls, max_pages: int = 10) -> DataFrame:
    """Follow next-page links from each start URL through landed pages; stop on
    a loop, a different host, a missing page or after ``max_pages`` pages.
    Output: start_url, step (1-based), page_id, url.

    Links are doubled: round i knows where 2^i links lead, so a chain of n pages takes log2(n) rounds.  A page that a start
    reaches twice is a loop; the earlier visit counts, and what follows the later one repeats what followed the earlier.
    Each round is written by a checkpoint.  Of pages with one URL the smallest id is taken."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    pg = pages.where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("page_id")).hint("merge")  # a row per page: no broadcast by a guessed size
    if isinstance(start_urls, DataFrame):
        s = start_urls.select(F.col("url").alias("start_url")).distinct()
    else:
        s = spark.createDataFrame([(u,) for u in dict.fromkeys(start_urls)], "start_url string")
    target = pg.select(F.col("url").alias("next_url"), F.col("page_id").alias("to")).hint("merge")
    near = nexts.join(pg.select("page_id", F.col("url").alias("from_url")).hint("merge"), "page_id")  # a chain stays on one host, link by link
    jump = (near.where(X.url_netloc("next_url") == X.url_netloc("from_url")).join(target, "next_url")
            .groupBy(F.col("page_id").alias("at")).agg(F.min("to").alias("to")).checkpoint(eager=True))
    seen = s.join(pg, s.start_url == pg.url).select("start_url", F.lit(1).alias("step"), F.col("page_id").alias("at")).checkpoint(eager=True)
    reach = 1  # seen holds the first ``reach`` pages of every chain
    while reach < max_pages:
        more = seen.join(jump, "at").select("start_url", (F.col("step") + reach).alias("step"), F.col("to").alias("at")).where(F.col("step") <= max_pages)
        before = seen.count()
        seen = seen.unionByName(more).groupBy("start_url", "at").agg(F.min("step").alias("step")).checkpoint(eager=True)
        reach *= 2
        if seen.count() == before:
            break
        if reach < max_pages:
            jump = jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")).checkpoint(eager=True)
    urls = pg.select(F.col("page_id").alias("at"), "url").hint("merge")
    return seen.join(urls, "at").select("start_url", "step", F.col("at").alias("page_id"), "url")
