"""Page and link queries over pages whose html is written from ``customer`` rows.

Every customer becomes one page with headings, paragraphs, an image, a table, a product card, contact and
social links, lists, a repository block and a next link, so what the extractors must find is plain SQL
over ``customer``.  Hosts hold 1000 customers each; the last page of a host links to one that never landed.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkeda.operators import graph as G
from sparkeda.operators import web as W
from sparkeda.operators.html import element_table
from sparkeda.plans.catalog import register, tbl
from sparkeda.session import spread

URL = "https://h{host}.example.com/c/{k}"
HTML = (
    '<html><head><title>{name}</title></head><body><h1>{name}</h1><h2>{seg}</h2><h3> </h3>'
    '<p>Balance of {name}</p><p></p><p>Nation {nat}</p><img src="/img/{k}.png" alt="{seg}">'
    '<table><caption>{seg}</caption><tr><th>Key</th><th>Nation</th></tr><tr><td>{k}</td><td>{nat}</td></tr></table>'
    '<div class="product-card"><h4>{name}</h4><span>$ {k}.50</span><img src="/p/{k}.png"></div>'
    '<p><a href="mailto:c{k}@mail.example.com?subject=x">mail</a> <a href="tel:555000{k}">call</a></p>'
    '<a href="https://github.com/c{k}/">code</a><ul class="menu"><li>{seg}</li></ul><ul></ul>'
    '<article class="Box-row"><h2><a href="/u{nat}/r{k}">repo</a></h2><p class="col-9">About {name}</p>'
    '<span itemprop="programmingLanguage">{seg}</span><a class="Link" href="/u{nat}/r{k}/stargazers">{k}</a></article>'
    '<a href="http://[bad">bad</a><a class="next" href="/c/{next}">Next</a></body></html>')
#: The fields of the texts above as columns of ``c`` in the SQL below.
C_SQL = ("WITH c AS (SELECT c_custkey AS page_id, c_custkey AS k, c_custkey + 1 AS next, c_custkey // 1000 AS host, c_name AS name, "
         "c_mktsegment AS seg, c_nationkey AS nat FROM customer) ")


def _filled(text: str):
    fields = {"k": F.col("c_custkey"), "next": F.col("c_custkey") + 1, "host": F.floor(F.col("c_custkey") / 1000), "name": F.col("c_name"),
              "seg": F.col("c_mktsegment"), "nat": F.col("c_nationkey")}
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


#: Pages written and parsed by one task, at most.
PAGES_PER_TASK = 10_000


def customer_pages(spark, sf_dir, html: str = HTML):
    """``page_id, url, html``: one page per customer."""
    customers = tbl(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    # a table of few small files would be parsed in few tasks: the rows are spread before they become pages
    return spread(customers, rows=PAGES_PER_TASK).select(F.col("c_custkey").alias("page_id"), _filled(URL).alias("url"), _filled(html).alias("html"))


def _sql(text: str) -> str:
    """``text`` with its fields as a SQL expression over ``c``."""
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p) or "''"


def _rows(*rows: dict) -> str:
    """The union over all customers of rows given as column -> text with fields, a number, or nothing."""
    return C_SQL + " UNION ALL ".join(
        "SELECT page_id, " + ", ".join(f"{_sql(v) if isinstance(v, str) else ('NULL' if v is None else v)} AS {n}" for n, v in r.items()) + " FROM c"
        for r in rows)


def _page_query(name: str, sql: str, make, reads: dict, reused: bool = False):
    """``reads``: what ``make`` reads of the element table, which is kept only if it is read more than once (``reused``)."""
    @register(name, sql)
    def query(spark, sf_dir):
        pages = customer_pages(spark, sf_dir)
        return make(element_table(pages, persist=reused, **reads), pages)
    return query


def _texts(*rows) -> str:
    return _rows(*[dict(zip(("nivel", "contenido"), r)) for r in rows])


HEADINGS = [("h1", "{name}"), ("h2", "{seg}"), ("h4", "{name}"), ("h2", "repo")]
PARAGRAPHS = [(1, "Balance of {name}"), (3, "Nation {nat}"), (4, "mailcall"), (5, "About {name}")]
HOST = "https://h{host}.example.com"

_page_query("h1_headings_customers", "SELECT *, CAST(length(contenido) AS INTEGER) AS longitud FROM (" + _texts(*HEADINGS) + ")",
            lambda el, _: W.headings(el).select("page_id", "nivel", "contenido", "longitud"), W.READS["headings"])
_page_query("h2_paragraphs_customers", "SELECT *, CAST(len(string_split(contenido, ' ')) AS INTEGER) AS n_palabras FROM ("
            + _rows(*[{"numero": n, "contenido": t} for n, t in PARAGRAPHS]) + ")",
            lambda el, _: W.paragraphs(el).select("page_id", "numero", "contenido", "n_palabras"), W.READS["paragraphs"])
LINKS = [("mail", "mailto:c{k}@mail.example.com?subject=x"), ("call", "tel:555000{k}"), ("code", "https://github.com/c{k}/"),
         ("repo", HOST + "/u{nat}/r{k}"), ("{k}", HOST + "/u{nat}/r{k}/stargazers"), ("bad", None), ("Next", HOST + "/c/{next}")]
_page_query("h4_links_customers", "SELECT page_id, texto, href, CAST(NOT starts_with(href, base) AS VARCHAR) AS es_externo FROM ("
            + _rows(*[{"texto": t, "href": h, "base": HOST} for t, h in LINKS]) + ")",
            lambda el, _: W.links(el).select("page_id", "texto", "href", F.col("es_externo").cast("string").alias("es_externo")), W.READS["links"])
_page_query("h5_images_customers", _rows({"src": HOST + "/img/{k}.png", "alt": "{seg}"}, {"src": HOST + "/p/{k}.png", "alt": ""}),
            lambda el, _: W.images(el).select("page_id", "src", "alt"), W.READS["images"])
_page_query("h6_table_summary_customers", "SELECT * REPLACE (CAST(filas AS BIGINT) AS filas) FROM ("
            + _rows({"titulo": "{seg}", "numero": 1, "filas": 2}) + ")",
            lambda el, _: W.table_summary(el).select("page_id", "titulo", "numero", "filas"), W.READS["tables"])
_page_query("h6_table_cells_customers", _rows(*[{"row_no": r, "col_no": c, "text": t} for r, c, t in
                                                [(1, 1, "Key"), (1, 2, "Nation"), (2, 1, "{k}"), (2, 2, "{nat}")]]),
            lambda el, _: W.table_cells(el).select("page_id", "row_no", "col_no", "text"), W.READS["cells"])
_page_query("h8_emails_customers", _rows({"contenido": "c{k}@mail.example.com"}),
            lambda el, _: W.emails(el).select("page_id", "contenido"), W.READS["emails"])
_page_query("h10_social_customers", _rows({"red": "github", "url": "https://github.com/c{k}"}),
            lambda _, pages: W.social_links(pages).select("page_id", "red", "url"), W.READS["social"])
_page_query("h11_products_customers", _rows({"nombre": "{name}", "precio": "$ {k}.50", "imagen": HOST + "/p/{k}.png"}),
            lambda el, _: W.products(el).select("page_id", "nombre", "precio", "imagen"), W.READS["products"])
_page_query("h12_by_tags_customers", _rows({"etiqueta": "p", "contenido": "About {name}"}),
            lambda el, _: W.by_tags(el, ["p", "li"], class_="col-9").select("page_id", "etiqueta", "contenido"), W.tags_read(["p", "li"]))
MENU = [W.Step(tag="ul", classes=("menu",)), W.Step(tag="li", axis="child")]
_page_query("h13_select_path_customers", _rows({"numero": 1, "contenido": "{seg}"}),
            lambda el, _: W.select_path(el, MENU).select("page_id", "numero", "contenido"), W.steps_read(MENU, "full_text"))
#: Blocks that differ in what comes first, last or not at all.
TRENDING = (
    '<html><body><article class="Box-row"><h2><a href="/u{nat}/r{k}">repo</a></h2><p class="x my-1">First {name}</p><p class="col-9">Second</p>'
    '<a class="Link" href="/u{nat}/r{k}/stargazers">1</a><a class="Link" href="/u{nat}/r{k}/forks">2</a><a class="Link" href="/a/stargazers">{k}</a>'
    '<a class="Link x" href="/a/forks">3{nat}</a><a href="/a/forks">4</a><span class="d-inline-block">9</span>'
    '<span class="d-inline-block float-sm-right">+{k},5 today</span></article>'
    '<article class="Box-row y"><h2><a>none</a></h2><span itemprop="programmingLanguage"> {seg} </span></article>'
    '<article class="Box-row"><h2>bare</h2><h2><a href="/not/here">x</a></h2></article>'
    '<article class="Box"><h2><a href="/not/either">x</a></h2></article></body></html>')


@register("h14_repeated_items_customers", _rows(
    {"autor": "u{nat}", "repositorio": "r{k}", "descripcion": "First {name}", "lenguaje": "N/A", "estrellas": "{k}", "forks": "3{nat}",
     "estrellas_hoy": "{k},5", "url": "https://github.com/u{nat}/r{k}"},
    {"autor": "", "repositorio": "", "descripcion": "", "lenguaje": "{seg}", "estrellas": "", "forks": "", "estrellas_hoy": "",
     "url": "https://github.com/"}))
def h14_repeated_items_customers(spark, sf_dir):
    pages = customer_pages(spark, sf_dir, TRENDING)
    return W.trending_items(element_table(pages, persist=False, **W.READS["trending"]))


H15_SQL = _rows({"titulo": "{name}", "n_encabezados": 3, "n_parrafos": 4, "n_listas": 1, "encabezados": "h1 {name}|h2 {seg}|h2 repo",
                 "parrafos": "Balance of {name}|Nation {nat}|mailcall|About {name}", "listas": "{seg}"})
_page_query("h15_page_summary_customers", "SELECT * REPLACE (CAST(n_encabezados AS BIGINT) AS n_encabezados, CAST(n_parrafos AS BIGINT) AS n_parrafos, "
            "CAST(n_listas AS BIGINT) AS n_listas) FROM (" + H15_SQL + ")",
            lambda el, _: W.page_summary(el).select(
                "page_id", "titulo", "n_encabezados", "n_parrafos", "n_listas",
                F.array_join(F.transform("encabezados", lambda h: F.concat_ws(" ", h["nivel"], h["texto"])), "|").alias("encabezados"),
                F.array_join("parrafos", "|").alias("parrafos"),
                F.array_join(F.transform("listas", lambda x: F.array_join(x, ",")), "|").alias("listas")), W.READS["summary"])

#: The strings and the whole text of the pages, from their html.
STRINGS_SQL = C_SQL[:-1] + f""", h AS (SELECT page_id, {_sql(HTML)} AS html FROM c) """
_page_query("h3_visible_text_customers", STRINGS_SQL + "SELECT page_id, trim(x) AS contenido FROM (SELECT page_id, "
            "unnest(regexp_split_to_array(html, '<[^>]*>')) AS x FROM h) WHERE trim(x) <> ''",
            lambda el, _: W.visible_text(el).select("page_id", "contenido"), W.READS["text"])
PHONE_SQL = W.PHONE_RE.replace("'", "''")
_page_query("h9_phones_customers", STRINGS_SQL + f"""SELECT DISTINCT page_id, trim(x) AS contenido FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', '', 'g'), '{PHONE_SQL}')) AS x FROM h
  UNION ALL SELECT page_id, '555000' || page_id FROM h) WHERE length(trim(x)) >= 7""",
            lambda el, _: W.phones(el).select("page_id", "contenido"), W.READS["phones"])


def _kinds_query(name: str, kinds: tuple, rows: list):
    """The value and type of the records of some kinds."""
    def make(el, pages):
        d = W.extract(el, kinds, pages=pages)
        some = F.coalesce(*[F.col(c) for c in ("contenido", "href", "src", "nombre", "url") if c in d.columns])
        return d.select("page_id", "tipo", F.coalesce(some, F.lit("")).alias("valor"))
    _page_query(name, _rows(*[{"tipo": t, "valor": v} for t, v in rows]), make, W.reads(*kinds), reused=W.scans(kinds) > 1)


_HEAD, _PAR = [("encabezado", t) for _, t in HEADINGS], [("parrafo", t) for _, t in PARAGRAPHS]
_LINK, _IMAGE = [("link", h or "") for _, h in LINKS], [("imagen", HOST + "/img/{k}.png"), ("imagen", HOST + "/p/{k}.png")]
_TABLE = [("tabla", "Tabla con 2 filas")]
_kinds_query("h7_everything_customers", ("headings", "paragraphs", "links", "images", "tables"), _HEAD + _PAR + _LINK + _IMAGE + _TABLE)
_kinds_query("h7_headings_links_customers", ("headings", "links"), _HEAD + _LINK)
_kinds_query("h7_contacts_products_customers", ("products", "emails", "social", "images"), _IMAGE + [
    ("producto", "{name}"), ("correo", "c{k}@mail.example.com"), ("red_social", "https://github.com/c{k}")])
_page_query("h16_headings_table_customers", _rows(*[{"nivel": n, "texto": t} for n, t in HEADINGS if n != "h4"]),
            lambda el, _: W.headings_table(el).select("page_id", "nivel", "texto"), W.READS["headings"])
_page_query("h16_paragraphs_table_customers", _rows(*[{"parrafo_num": i, "texto": t} for i, (_, t) in enumerate(PARAGRAPHS, 1)]),
            lambda el, _: W.paragraphs_table(el).select("page_id", "parrafo_num", "texto"), W.READS["paragraphs"])
_page_query("h17_page_kind_customers", _rows({"kind": "estatico"}), lambda el, pages: W.page_kind(pages, el).select("page_id", "kind"), W.READS["kind"])
_page_query("g1_link_edges_customers", _rows(*[{"src_url": URL, "dst_url": HOST + d} for d in
                                               ("/c/{next}", "/u{nat}/r{k}", "/u{nat}/r{k}/stargazers")]),
            lambda el, _: G.link_edges(el).select("page_id", "src_url", "dst_url"), W.READS["edges"])
_page_query("g3_next_page_customers", _rows({"next_url": HOST + "/c/{next}"}),
            lambda el, _: G.next_page(el).select("page_id", "next_url"), W.READS["next"])


def _first_of_hosts(pages):
    return pages.where("page_id % 1000 = 0").select("url")


_page_query("g2_reachable_customers", C_SQL + f"SELECT page_id, {_sql(URL)} AS url, CAST(page_id % 1000 AS INTEGER) AS level FROM c "
            "WHERE page_id % 1000 <= 5",
            lambda el, pages: G.reachable(pages, G.link_edges(el), _first_of_hosts(pages), depth=5).select("page_id", "url", "level"), W.READS["edges"])
_page_query("g3_page_chain_customers", C_SQL + f"SELECT {_sql(HOST + '/c/')} || CAST(host * 1000 AS VARCHAR) AS start_url, "
            f"CAST(page_id % 1000 + 1 AS INTEGER) AS step, page_id, {_sql(URL)} AS url FROM c WHERE page_id % 1000 < 10",
            lambda el, pages: G.page_chain(pages, G.next_page(el), _first_of_hosts(pages), max_pages=10), W.READS["next"])

IN_ARTICLE, NEXT_LINK = [W.Step(tag="article"), W.Step(tag="a")], [W.Step(tag="a", classes=("next",))]
_page_query("g3_next_page_steps_customers", _rows({"next_url": HOST + "/u{nat}/r{k}"}),
            lambda el, _: G.next_page(el, IN_ARTICLE).select("page_id", "next_url"), W.steps_read(IN_ARTICLE, "url"))
_page_query("g3_page_chain_long_customers", C_SQL + f"SELECT {_sql(HOST + '/c/')} || CAST(host * 1000 AS VARCHAR) AS start_url, "
            f"CAST(page_id % 1000 + 1 AS INTEGER) AS step, page_id, {_sql(URL)} AS url FROM c",
            lambda el, pages: G.page_chain(pages, G.next_page(el, NEXT_LINK), _first_of_hosts(pages), max_pages=1000),
            W.steps_read(NEXT_LINK, "url"))


#: Records of the pages by kind with every column of theirs; a kind without a column has null there.
_RECORDS = [dict(tipo="encabezado", nivel=n, contenido=t) for n, t in HEADINGS] + [dict(tipo="parrafo", numero=n, contenido=t) for n, t in PARAGRAPHS] + [
    dict(tipo="link", texto=t, href=h) for t, h in LINKS] + [
    dict(tipo="imagen", src=HOST + s, alt=a, titulo="", width="", height="") for s, a in (("/img/{k}.png", "{seg}"), ("/p/{k}.png", ""))] + [
    dict(tipo="tabla", numero=1, titulo="{seg}", filas=2, contenido="Tabla con 2 filas")]
_COLUMNS = ("tipo", "nivel", "numero", "contenido", "texto", "href", "src", "alt", "titulo", "width", "height", "filas")
A12_SQL = f"""WITH r AS (SELECT * EXCLUDE (page_id, base), NOT starts_with(href, base) AS es_externo,
  CASE WHEN tipo IN ('encabezado', 'parrafo') THEN length(contenido) END AS longitud,
  CASE WHEN tipo IN ('encabezado', 'parrafo') THEN len(string_split(contenido, ' ')) END AS n_palabras
  FROM ({_rows(*[{c: r.get(c) for c in _COLUMNS} | {"base": HOST} for r in _RECORDS])})),
g AS (SELECT *, count(*) AS n FROM r GROUP BY ALL)
SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS kind, CAST(sum(n) AS BIGINT) AS value FROM g
UNION ALL SELECT 'empty_content', NULL, CAST(sum(n) FILTER (WHERE contenido IS NULL OR contenido = '') AS BIGINT) FROM g
UNION ALL SELECT 'duplicates', NULL, CAST(sum(n) - count(*) AS BIGINT) FROM g
UNION ALL SELECT 'images_without_src', NULL, CAST(coalesce(sum(n) FILTER (WHERE tipo = 'imagen' AND (src IS NULL OR src = '')), 0) AS BIGINT) FROM g
UNION ALL SELECT 'records_per_kind', tipo, CAST(sum(n) AS BIGINT) FROM g GROUP BY tipo"""


@register("a12_quality_customers", A12_SQL)
def a12_quality_customers(spark, sf_dir):
    """The report over every column of the records; where they stand (page_id, node_id) is none of them."""
    from sparkeda.operators.profile import quality_report

    return quality_report(W.everything(element_table(customer_pages(spark, sf_dir), **W.reads(*W.EVERYTHING))).drop("page_id", "node_id"))


H20_SQL = """WITH l AS (SELECT *, event_id % 6 AS i FROM events), r AS (
  SELECT CASE i WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 ELSE 200 END AS status, i = 1 AS redirected, length(event_type) AS bytes, value AS seconds FROM l)
SELECT CASE WHEN status = 200 THEN 'ok' WHEN status IN (403, 404) OR status >= 500 THEN 'failed' ELSE 'warning' END AS status_class,
  count(*) AS fetches, count(*) FILTER (WHERE redirected) AS redirects, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(seconds), 6) AS avg_seconds FROM r GROUP BY 1"""


@register("h20_fetch_log", H20_SQL)
def h20_fetch_log(spark, sf_dir):
    """A fetch log from the events: what came back, redirects, sizes and times per class."""
    i, url = F.col("event_id") % 6, F.concat(F.lit("https://e.example.com/"), F.col("event_id").cast("string"))
    status = F.when(i == 0, 404).when(i == 1, 301).when(i == 2, 503).otherwise(200)
    log = tbl(spark, sf_dir, "events").select(url.alias("url"), status.alias("status"), F.when(i == 1, F.concat(url, F.lit("/new"))).otherwise(url).alias("final_url"),
                                              F.length("event_type").alias("bytes"), F.col("value").alias("seconds"))
    return W.fetch_log_summary(log).withColumn("avg_seconds", F.round("avg_seconds", 6))
