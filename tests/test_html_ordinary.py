"""Ordinary markup is read by one expression, with the nodes that the library's parser gives."""

import random
from html.parser import HTMLParser

from sparkeda.operators import html as H
from sparkeda.plans import q_pages

PARTS = ['<p>', '</p>', '<P>', '</DIV >', '<div class=" a  b ">', '</div>', '<br>', '<br/>', '<img src="/x.png" alt="">', '<a href="/a?b=1&amp;c">', "<a href='/q'>",
         '<a href="/x" rel="next  nofollow">', '</a>', 'text', ' a &amp; b ', '&copy', '&#39;', '<', '< b', '<!-- c -->', '<!-- a-b -->', '<!---->', '<!DOCTYPE html>',
         '<!doctype html>', '<script>var t="</p>"; a < b && c;</script>', '<script src="/s.js"></script>', '<script>"</SCRIPT >"', '<style>p{}</style>', '<style>a<!-- b',
         '<title>T &lt; t</title>', '<title>a<b>c</title>', '<textarea><p>x</textarea>', '<li data-k1="v">', '</li>', '<td a=b c>', '<svg:x>', '<x-y>', '</x-y>', '<p\n>', '<p ',
         '<![CDATA[ x ]]>', '<?pi x?>', '\n', 'é&nbsp;ß', '</>', '<a b="x" b="y">', '<p a="1"b="2">', '&am', 'p;', '<noscript><p>n</p></noscript>']


def _slow(monkeypatch):
    monkeypatch.setattr(H._TreeBuilder, "goahead", HTMLParser.goahead)


def test_same_nodes_as_the_library(monkeypatch):
    rnd = random.Random(5)
    pages = ["".join(rnd.choices(PARTS, k=rnd.randint(1, 25))) for _ in range(4000)] + [q_pages.HTML, q_pages.TRENDING]

    def nodes():
        return [list(H.parse_html(1, "u", p, True, source_chars=80)) for p in pages]

    got = nodes()
    _slow(monkeypatch)
    assert got == nodes()


def test_ordinary_pages_do_not_reach_the_library(monkeypatch):
    """Every page query pays for each tag; those of ordinary pages cost one match."""
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: 1 / 0)
    for page in (q_pages.HTML, q_pages.TRENDING, '<!DOCTYPE html><script>var t="</p>";</script><!-- x --><p>a'):
        assert list(H.parse_html(1, "u", page))[0][-1] is None  # no error


def test_only_what_is_asked_for_is_made(monkeypatch):
    """Nodes of other tags are numbered and not kept, strings likewise, and the attributes of elements that nobody asks for are not read."""
    read, real = [], H._attributes
    monkeypatch.setattr(H, "_attributes", lambda pairs: read.append(pairs) or real(pairs))
    b = H._TreeBuilder(q_pages.HTML, frozenset(["h1", "img"]), keep_strings=False, with_single=False)
    b.feed(q_pages.HTML)
    b.finish()
    assert [n["tag"] for n in b.nodes] == ["h1", "img", "img"] and not read
    whole = [r for r in H.parse_html(1, "u", q_pages.HTML) if r[8] == "img"]
    read.clear()
    assert list(H.parse_html(1, "u", q_pages.HTML, keep_strings=False, tags={"img"})) == whole and len(read) == 2


def test_one_string_of_an_element():
    """An element's single string, through single children only, whatever else is asked for."""
    page = "<a>x</a><a><b>y</b></a><a><b>y</b>z</a><a></a><a><!-- c --></a><a><b><i>w</i></b></a><br/>"
    got = [(r[2], r[-1]) for r in H.parse_html(1, "u", page, keep_strings=False, tags={"a"}, columns=["page_id", "kind", "node_id", "own_string"])]
    assert [s for _, s in got] == ["x", "y", None, None, " c ", "w"] and [n for n, _ in got] == [1, 3, 6, 10, 11, 13]
