"""Extractors on own small pages (images, tables, h2-h6, mailto/tel, social links,
product cards, next-page links, an empty root div)."""

import pytest
from pyspark.sql import functions as F

from sparkeda.operators import graph as G
from sparkeda.operators import web as W
from sparkeda.operators.html import parse_html, parse_pages

SHOP = """<!DOCTYPE html><html><head><title>Shop &amp; Co</title><script>var x = "<p>no</p>";</script></head>
<body><h2>Catalogue</h2><h3> </h3><h6>Small print</h6>
<div class="product-card"><h3>Lamp</h3><span>$ 1,299.00</span><img src="/img/lamp.png" alt="lamp"></div>
<div class="product-card"><a href="/p/2">Chair</a><span>15.50 USD</span></div>
<div class="card"><h4>Not chosen</h4></div>
<p>Write to <a href="mailto:sales@shop.example.com?subject=hi">us</a> or info@shop.example.com,
call +52 55 1234 5678 or <a href="tel:5550001111">phone</a>.</p><p></p>
<table><caption>Prices</caption><tr><th>Item</th><th>Price</th></tr><tr><td>Lamp</td><td>10</td></tr></table>
<table><tr><td>x</td></tr></table>
<a href="https://facebook.com/shopco/">fb</a> <a href="https://github.com/shop/repo">gh</a>
<ul><li>menu</li></ul><div class="pagination"><a href="/page/1">1</a><a href="/page/2">2</a></div>
<a href="#top">top</a><a href="/p/2#frag">frag</a><a href="https://other.example.org/x">ext</a>
</body></html>"""

SPA = '<html><head><script src="bundle.js"></script></head><body><div id="root"></div></body></html>'

PAGE2 = '<html><body><p>Page two</p><a class="next" href="/page/3">Next</a><a href="/page/1">back</a></body></html>'
PAGE3 = '<html><body><p>Three</p><a rel="next" href="/page/2">again</a></body></html>'

TREND = """<html><body><article class="Box-row"><h2><a href="/alice/tool">alice / tool</a></h2>
<p class="col-9 color-fg-muted my-1">A useful tool</p><span itemprop="programmingLanguage">Rust</span>
<a class="Link" href="/alice/tool/stargazers">1,234</a><a class="Link" href="/alice/tool/forks">56</a>
<span class="d-inline-block float-sm-right">78 stars today</span></article>
<article class="Box-row"><h2><a href="/bob/lib">bob / lib</a></h2></article></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://shop.example.com/catalog?x=1", SHOP), (2, "https://shop.example.com/page/2", PAGE2),
            (3, "https://shop.example.com/page/3", PAGE3), (4, "https://spa.example.com/", SPA),
            (5, "https://github.com/trending", TREND)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def el(pages):
    return parse_pages(pages, with_raw_text=True, source_chars=300).persist()


def test_tree_rules():
    nodes = list(parse_html(1, "u", "<p><b>x<br><p>y</p></b>z</p></i><img src=a>"))
    tags = [(n[8], n[3]) for n in nodes if n[7] == "element"]
    # p(1) > b(2) > [br(4), p(5)]; stray </i> ignored; img under document
    assert tags[:4] == [("[document]", None), ("p", 0), ("b", 1), ("br", 2)]
    full = {n[8] + str(n[2]): n[14] for n in nodes if n[7] == "element"}
    assert full["p1"] == "xyz" and full["[document]0"] == "xyz"


def test_headings_paragraphs_text(el):
    h = {(r.page_id, r.nivel, r.contenido) for r in W.headings(el).collect()}
    assert (1, "h2", "Catalogue") in h and (1, "h6", "Small print") in h
    assert not any(r[1] == "h3" and r[2] == "" for r in h)
    p = [r for r in W.paragraphs(el).where("page_id = 1").collect()]
    assert len(p) == 1 and p[0].numero == 1 and p[0].contenido.startswith("Write to")
    vt = W.visible_text(el).where("page_id = 1").collect()
    assert all("no" not in r.contenido or r.etiqueta != "script" for r in vt)
    assert any(r.etiqueta == "title" and r.contenido == "Shop & Co" for r in vt)


def test_links_images_tables(el):
    links = {r.href: r.es_externo for r in W.links(el).where("page_id = 1").collect()}
    assert links["https://shop.example.com/p/2"] is False
    assert links["https://other.example.org/x"] is True
    img = W.images(el).collect()
    assert [(r.src, r.alt, r.width) for r in img] == [("https://shop.example.com/img/lamp.png", "lamp", "")]
    ts = {r.numero: (r.titulo, r.filas) for r in W.table_summary(el).collect()}
    assert ts == {1: ("Prices", 2), 2: ("Tabla_2", 1)}
    cells = W.table_cells(el).where("table_no = 1").orderBy("row_no", "col_no").collect()
    assert [(c.row_no, c.col_no, c.is_header, c.text) for c in cells][:3] == [(1, 1, True, "Item"), (1, 2, True, "Price"),
                                                                              (2, 1, False, "Lamp")]
    ev = W.everything(el).groupBy("tipo").count().collect()
    assert {r.tipo for r in ev} == {"encabezado", "parrafo", "link", "imagen", "tabla"}


def test_contacts_social(el, pages):
    em = {r.contenido for r in W.emails(el).collect()}
    assert em == {"sales@shop.example.com", "info@shop.example.com"}
    ph = {r.contenido for r in W.phones(el).collect()}
    assert "5550001111" in ph and any("1234" in p for p in ph)
    so = {(r.red, r.url) for r in W.social_links(pages).collect()}
    assert ("facebook", "https://facebook.com/shopco") in so and ("github", "https://github.com/shop/repo") in so


def test_products_first_pattern(el):
    pr = W.products(el).where("page_id = 1").orderBy("node_id").collect()
    assert [(r.nombre, r.precio) for r in pr] == [("Lamp", "$ 1,299.00"), ("Chair", "15.50 USD")]
    assert pr[0].imagen == "https://shop.example.com/img/lamp.png" and pr[0].pattern == 0


def test_select_path_and_tags(el, pages):
    steps = [W.Step(tag="div", classes=("pagination",)), W.Step(tag="a")]
    got = W.select_path(el, steps, with_source=True).orderBy("numero").collect()
    assert [r.contenido for r in got] == ["1", "2"] and got[0].html.startswith("<a href=\"/page/1\">")
    child = W.match_count(el, [W.Step(tag="ul"), W.Step(tag="a", axis="descendant")]).collect()
    assert child == []
    bt = W.by_tags(el, ["div"], class_="card").collect()
    assert [r.contenido for r in bt] == ["Not chosen"]


def test_repeated_items(el):
    t = W.trending_items(el).orderBy("autor").collect()
    assert [(r.autor, r.repositorio, r.lenguaje, r.estrellas, r.forks, r.estrellas_hoy) for r in t] == [
        ("alice", "tool", "Rust", "1,234", "56", "78"), ("bob", "lib", "N/A", "", "", "")]
    assert t[0].descripcion == "A useful tool"


def test_summary_kind(el, pages):
    s = {r.page_id: r for r in W.page_summary(el).collect()}
    assert s[1].titulo == "Shop & Co" and s[1].n_encabezados == 2 and s[1].n_listas == 1
    assert s[4].titulo == "Sin título"
    k = {r.page_id: r.kind for r in W.page_kind(pages, el).collect()}
    assert k[4] == "dinamico" and k[1] == "estatico"


def test_graph(spark, el, pages):
    e = G.link_edges(el)
    dst = {r.dst_url for r in e.where("page_id = 1").collect()}
    assert "https://shop.example.com/p/2" in dst and not any("#" in d for d in dst)
    assert "https://other.example.org/x" not in dst
    r = G.reachable(pages, e, ["https://shop.example.com/catalog?x=1"], depth=2).collect()
    assert {(x.url, x.level) for x in r} == {("https://shop.example.com/catalog?x=1", 0),
                                             ("https://shop.example.com/page/2", 1), ("https://shop.example.com/page/3", 2)}
    nx = {x.page_id: x.next_url for x in G.next_page(el).collect()}
    assert nx[1] == "https://shop.example.com/page/2" and nx[2] == "https://shop.example.com/page/3"
    ch = G.page_chain(pages, G.next_page(el), ["https://shop.example.com/page/2"], max_pages=5).orderBy("step").collect()
    assert [c.url for c in ch] == ["https://shop.example.com/page/2", "https://shop.example.com/page/3"]


def test_fetch_log(spark):
    log = spark.createDataFrame([("u1", 200, "u1", 10, 0.1), ("u2", 404, "u2", 0, 0.2), ("u3", 301, "u4", 5, 0.3),
                                 ("u5", 503, "u5", 0, 1.0)], "url string, status int, final_url string, bytes long, seconds double")
    r = {x.url: (x.status_class, x.redirected) for x in W.fetch_log_report(log).collect()}
    assert r == {"u1": ("ok", False), "u2": ("failed", False), "u3": ("warning", True), "u5": ("failed", False)}
    s = {x.status_class: x.fetches for x in W.fetch_log_summary(log).collect()}
    assert s == {"ok": 1, "failed": 2, "warning": 1}


def test_crawl_limit(spark, el, pages):
    e = G.link_edges(el)
    r = G.reachable(pages, e, ["https://shop.example.com/catalog?x=1"], depth=5, max_pages=2).collect()
    assert [x.url for x in sorted(r, key=lambda x: (x.level, x.order))] == [
        "https://shop.example.com/catalog?x=1", "https://shop.example.com/page/2"]


def test_next_page_single_string_rule(spark):
    rows = [(10, "https://n.example.com/a", '<a href="/x"><b>›</b> more</a><a href="/y">›</a>'),
            (11, "https://n.example.com/b", '<a href="/x"><b>›</b> more</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nx = {r.page_id: r.next_url for r in G.next_page(parse_pages(pages)).collect()}
    assert nx == {10: "https://n.example.com/y"}


def test_bad_reference_gives_null(spark):
    from sparkeda.functions.text import url_join
    df = spark.createDataFrame([("http://a/b/", "c"), ("http://a/", "http://[bad"), ("http://a/", None)], "b string, r string")
    assert [r[0] for r in df.select(url_join("b", "r")).collect()] == ["http://a/b/c", None, None]


def test_chains_double(spark):
    """Long chains, loops, other hosts, missing pages and the page limit, against a walk."""
    def url(k, host="a"):
        return f"https://{host}.example.com/{k}"
    rows = [(k, url(k), url(k + 1)) for k in range(40)] + [(50, url(50), url(51)), (51, url(51), url(52)), (52, url(52), url(51))]
    rows += [(60, url(60), url(61)), (61, url(61), url(60, "b")), (62, url(60, "b"), url(61, "b")), (63, url(63), url(63)), (64, url(64), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, next_url string")
    nexts = pages.where("next_url IS NOT NULL").select("page_id", "next_url")
    by_url, nxt = {u: k for k, u, _ in rows}, {k: n for k, _, n in rows}
    starts = [url(0), url(33), url(50), url(60), url(63), url(64), url(999)]
    for most in (1, 2, 5, 16, 100):
        want = set()
        for s in starts:
            u, seen = s, set()
            while u in by_url and u not in seen and len(seen) < most and u.split("/")[2] == s.split("/")[2]:
                seen.add(u)
                want.add((s, len(seen), by_url[u], u))
                u = nxt[by_url[u]]
        assert {tuple(r) for r in G.page_chain(pages.select("page_id", "url"), nexts, starts, max_pages=most).collect()} == want


def test_each_level_is_written_once(spark, monkeypatch):
    """What a crawl writes is its pages, once each, whatever its depth."""
    from pyspark.sql.classic.dataframe import DataFrame
    rows = [(k, f"https://a.example.com/{k}") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    edges = spark.createDataFrame([(k, f"https://a.example.com/{k + d}", d) for k in range(30) for d in (1, 2)], "page_id long, dst_url string, link_pos int")
    written, real = [], DataFrame.checkpoint

    def counted(self, eager=True):
        out = real(self, eager)
        written.append(out.count())
        return out
    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    got = G.reachable(pages, edges, ["https://a.example.com/0"], depth=9).collect()
    assert {(r.page_id, r.level) for r in got} == {(k, (k + 1) // 2) for k in range(19)} and sum(written) == len(got)


def test_fields_of_nested_items(spark):
    html = ('<div class="it"><b><i>1</i></b><i>2</i><div class="it"><i>3</i></div></div><div class="it"><b></b><b><i>4</i></b></div><div class="it"></div>')
    el = parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    b, i = W.Step(tag="b"), W.Step(tag="i")
    child = W.Step(tag="i", axis="child")
    got = W.repeated_items(el, [W.Step(classes=("it",))], {
        "i": W.Field((i,)), "last": W.Field((i,), last=True), "b": W.Field((b,)), "in_b": W.Field((b, i)), "first_b": W.Field((b, i), in_first=True),
        "below_b": W.Field((b, child), None, "-")}).orderBy("item_id").collect()
    assert [tuple(r)[2:] for r in got] == [("1", "3", "1", "1", "1", "1"), ("3", "3", None, None, None, "-"), ("4", "4", "", "4", None, "4"),
                                           (None, None, None, None, None, "-")]
    plan = W.trending_items(el)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


def test_parser_is_linear_and_reports(spark):
    import time
    t0 = time.time()
    assert sum(1 for _ in parse_html(1, "u", "<ul>" + "<li>a</li>" * 100_000 + "</ul>", text_tags=())) == 200_002
    assert time.time() - t0 < 20
    rows = parse_pages(spark.createDataFrame([(1, "u", "<p>a<![endif x"), (2, "u", "<p>b")], "page_id long, url string, html string")).where("node_id = 0").collect()
    assert {r.page_id for r in rows} == {1, 2} and [r.error for r in rows if r.page_id == 2] == [None]


def test_extract_kinds(el, pages):
    d = W.extract(el, ("headings", "text"))
    assert {r.tipo for r in d.collect()} == {"encabezado", "texto"} and "href" not in d.columns
    both = W.extract(el, W.KINDS, pages=pages).groupBy("tipo").count().collect()
    alone = {"encabezado": W.headings(el), "parrafo": W.paragraphs(el), "texto": W.visible_text(el), "link": W.links(el), "imagen": W.images(el),
             "tabla": W.table_summary(el), "producto": W.products(el), "correo": W.emails(el), "telefono": W.phones(el), "red_social": W.social_links(pages)}
    assert {r.tipo: r["count"] for r in both} == {k: n for k, v in alone.items() if (n := v.count())}
    cols = ["page_id", "node_id", "texto", "href", "es_externo"]
    assert sorted(map(tuple, W.extract(el, ("links", "images")).where("tipo = 'link'").select(cols).collect())) == sorted(map(tuple, W.links(el).select(cols).collect()))
    for bad in ((), ("nothing",), ("social",)):
        with pytest.raises(ValueError):
            W.extract(el, bad)
