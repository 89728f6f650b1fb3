"""H0: pages -> element table, one Spark job (``mapInArrow``).

Each page is parsed by the standard-library ``html.parser`` inside the task
(a per-row helper); everything downstream is ordinary DataFrame work on the
element table.  Tree rules (as the reference's parser backend builds them):
void elements close at once; an end tag closes up to the nearest open
element of that name; an unmatched end tag is ignored; no implicit closing.

Columns
  page_id, url, node_id (pre-order, 0 = the document), parent_id, depth,
  path (ancestor ids, document first), path_tags, kind (element | text |
  comment | doctype | cdata), tag, parent_tag, attrs, classes, is_last
  (last element child of its parent), text (string nodes: the raw string),
  full_text (elements: stripped strings joined with no separator, as
  ``get_text(strip=True)``), raw_text (optional: unstripped ``get_text()``),
  src_start / src_end (character offsets of the element in ``html``),
  tag_pos (1-based ordinal of the element among same-tag elements of the page),
  own_string (the element's single string: set when its content reduces, through
  single children, to one string node, else NULL).
  ``raw_text`` is always filled for the document node (``get_text()``).
  source (optional: the first characters of the element's html), error (document
  node: why the page could not be parsed to its end, else NULL).
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Elements that never take content (closed at once).
VOID_TAGS = frozenset("""area base br col embed hr img input keygen link menuitem meta param source track wbr
basefont bgsound command frame image isindex nextid spacer""".split())
# Elements whose strings are not ordinary text.
STRING_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])
# Attributes holding a whitespace-separated list.
MULTI_VALUED = frozenset(["class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone"])

ELEMENT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("path_tags", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()), T.StructField("parent_tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("is_last", T.BooleanType()),
    T.StructField("text", T.StringType()), T.StructField("full_text", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("src_start", T.IntegerType()), T.StructField("src_end", T.IntegerType()),
    T.StructField("tag_pos", T.IntegerType()), T.StructField("own_string", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("error", T.StringType()),
])

_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()),
    ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("path_tags", pa.list_(pa.string())),
    ("kind", pa.string()), ("tag", pa.string()), ("parent_tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())),
    ("is_last", pa.bool_()), ("text", pa.string()), ("full_text", pa.string()), ("raw_text", pa.string()),
    ("src_start", pa.int32()), ("src_end", pa.int32()), ("tag_pos", pa.int32()), ("own_string", pa.string()), ("source", pa.string()), ("error", pa.string()),
])

_PLAIN = "plain"

# Markup that every version of the library's parser reads alike: lower-case end tags and start tags (quoted values without references), and
# comments without dashes, the common doctype, scripts and styles that hold no start of a comment or of such an end tag.
_ATTRS = r'((?: [a-z][a-z0-9-]*="[^"&]*")*)'
_ORDINARY = re.compile(
    r'([^<]*)<(?:/([a-z][a-z0-9]*)>'
    r'|(?!(?:script|style|textarea|iframe|noembed|noframes|noscript|plaintext|xmp)[ >])(?!title(?!>[^<]*</title>))([a-z][a-z0-9]*)' + _ATTRS + '>'
    r'|(script|style)' + _ATTRS + r'>([^<]*(?:<(?!(?i:/\s*script|/\s*style|!--))[^<]*)*)</\5>'
    r'|!--([^->][^-]*)-->|!(DOCTYPE html)>)').match
_PAIRS = re.compile(r'([a-z0-9-]+)="([^"]*)"').findall


def _attributes(pairs) -> tuple:
    """The attributes of a start tag and its classes."""
    amap, classes = {}, []
    for k, v in pairs:
        amap[k] = "" if v is None else v
    if "class" in amap:
        classes = amap["class"].split()
    for k in MULTI_VALUED & amap.keys():
        amap[k] = " ".join(amap[k].split())
    return amap, classes


class _TreeBuilder(HTMLParser):
    """Builds flat node records for one page."""

    def __init__(self, html: str, tags=None, keep_strings: bool = True, with_pieces: bool = True, with_single: bool = True):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.tags = None if with_single else tags  # the elements to keep; an element's one string is found through all nodes
        self.keep_strings, self.with_pieces = keep_strings or with_single, with_pieces
        self.base = self.at = 0  # where the parser's buffer starts in the html, and where it stands in that buffer
        # node records: dicts appended in pre-order; all nodes are numbered, those that nobody asks for are not kept
        self.count = 0
        self.nodes: list[dict] = []
        self.pieces: list[tuple[str, str, str]] = []  # (stripped, raw, string type)
        self.stack = [self._new_element("[document]", {}, [], None, 0)]
        self.buffer: list[str] = []

    # helpers -----------------------------------------------------------
    def goahead(self, end):
        """Ordinary markup is read here; from the first that is not on the library's parser reads the page."""
        if not end and not self.base:
            self._ordinary()
        super().goahead(end)

    def _ordinary(self):
        """A match for each tag and the text before it.  What most tags need is done in place: this loop is the parse's time."""
        html, tags, nodes, pieces, stack, i = self.rawdata, self.tags, self.nodes, self.pieces, self.stack, 0
        keep_strings, with_pieces = self.keep_strings, self.with_pieces
        while m := _ORDINARY(html, i):
            text, close, tag, attrs, raw_tag, raw_attrs, raw, comment, decl = m.groups()
            i = m.end()
            if text:
                if keep_strings or with_pieces:
                    self._add_string("text", unescape(text) if "&" in text else text)
                else:
                    self.count += 1
            if close:
                if stack[-1]["tag"] == close:
                    el = stack.pop()
                    el["src_end"], el["close_piece"] = i, len(pieces)
                else:
                    self._end(close, i)
            elif tag:
                parent = stack[-1]
                node = {"node_id": self.count, "kind": "element", "tag": tag, "attrs": attrs, "classes": None, "parent": parent,
                        "src_start": m.end(1), "src_end": i, "open_piece": len(pieces), "close_piece": len(pieces), "last": None,
                        "inside": tag if tag in STRING_CONTAINERS else parent["inside"]}
                self.count += 1
                parent["last"] = node
                if tags is None or tag in tags:
                    nodes.append(node)
                if tag not in VOID_TAGS:
                    stack.append(node)
            elif raw_tag:
                stack.append(self._new_element(raw_tag, raw_attrs, None, stack[-1], m.end(1)))
                if raw:
                    self._add_string("text", raw)
                self._end(raw_tag, i)
            elif comment:
                self._add_string("comment", comment)
            else:
                self._add_string("doctype", decl[len("DOCTYPE "):])
        self.rawdata, self.base, self.at = html[i:], i, 0

    def updatepos(self, i, j):
        self.at = max(i, j)  # offsets only: lines are not counted
        return j

    def _offset(self) -> int:
        return self.base + self.at

    def _new_element(self, tag, attrs, classes, parent, start):
        """``attrs``: the attributes, or (with no ``classes``) their markup, read when someone asks for them."""
        node = {"node_id": self.count, "kind": "element", "tag": tag, "attrs": attrs, "classes": classes,
                "parent": parent, "src_start": start, "src_end": None, "open_piece": len(self.pieces), "last": None,
                "inside": tag if tag in STRING_CONTAINERS else parent["inside"] if parent is not None else _PLAIN}
        self.count += 1
        if parent is not None:
            parent["last"] = node
        if self.tags is None or tag in self.tags:
            self.nodes.append(node)
        return node

    def _add_string(self, kind: str, text: str):
        parent = self.stack[-1]
        if self.keep_strings:
            self.nodes.append({"node_id": self.count, "kind": kind, "tag": None, "parent": parent, "text": text})
        self.count += 1
        if self.with_pieces and kind in ("text", "cdata"):
            stype = parent["inside"] if kind == "text" else "cdata"
            self.pieces.append((text.strip(), text, stype))

    def _flush(self):
        if self.buffer:
            self._add_string("text", "".join(self.buffer))
            self.buffer = []

    def _close(self, el, end_offset):
        el["src_end"] = end_offset
        el["close_piece"] = len(self.pieces)

    # parser callbacks ---------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        start = self._offset()
        el = self._new_element(tag, *_attributes(attrs), self.stack[-1], start)
        if tag in VOID_TAGS:
            self._close(el, start + len(self.get_starttag_text() or ""))
        else:
            self.stack.append(el)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        start = self._offset()
        amap = {k: ("" if v is None else v) for k, v in attrs}
        classes = amap["class"].split() if "class" in amap else []
        el = self._new_element(tag, amap, classes, self.stack[-1], start)
        self._close(el, start + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        self._flush()
        gt = self.html.find(">", self._offset())
        self._end(tag, gt + 1 if gt >= 0 else len(self.html))

    def _end(self, tag, end):
        """An end tag closes up to the nearest open element of its name; an unmatched one is ignored."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i]["tag"] == tag:
                for el in self.stack[i:]:
                    self._close(el, end)
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add_string("comment", data)

    def handle_decl(self, decl):
        self._flush()
        self._add_string("doctype", decl[len("DOCTYPE "):] if decl.startswith("DOCTYPE ") else decl)

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._add_string("cdata", data[len("CDATA["):])
        else:
            self._add_string("doctype", data)

    def handle_pi(self, data):
        self._flush()
        self._add_string("comment", data)

    def finish(self):
        self.base, self.at = len(self.html) - len(self.rawdata), 0
        self.close()
        self._flush()
        end = len(self.html)
        for el in self.stack:
            self._close(el, end)
        self.stack = []


def _single_strings(nodes):
    """Give every element the one string it reduces to through single children, else None; children first."""
    for node in reversed(nodes):
        is_element, parent = node["kind"] == "element", node["parent"]
        single = node["single"] = (node["child"] if node.get("children") == 1 else None) if is_element else node["text"]
        if parent is not None:
            parent["children"], parent["child"] = parent.get("children", 0) + 1, single


def _wanted_type(tag: str) -> set:
    return {tag} if tag in STRING_CONTAINERS else {_PLAIN, "cdata"}


def _below(parent) -> tuple:
    """Ids and tags of the ancestors that the children of ``parent`` have: kept with it, the lists are shared by all children."""
    chain = []
    while parent is not None and "below" not in parent:
        chain.append(parent)
        parent = parent["parent"]
    below = ((), ()) if parent is None else parent["below"]
    for node in reversed(chain):
        below = node["below"] = (*below[0], node["node_id"]), (*below[1], node["tag"])
    return below


def parse_html(page_id: int, url: str, html: str, with_raw: bool = False, text_tags=None,
               keep_strings: bool = True, source_chars: int = 0, tags=None, columns=None):
    """Yield node records (tuples in ``ELEMENT_SCHEMA`` order, or of ``columns``) for one page.

    ``text_tags``: compute ``full_text`` / ``raw_text`` only for these tags (the
    document node always); None = every element.  ``keep_strings``: emit the
    string nodes (needed by visible-text extraction only).  ``source_chars``: emit so many
    characters of each element's html.  ``tags``: emit only elements of these tags (the document node is
    ``[document]``); None = all.  A page whose parse breaks off keeps what
    was built, and its document node says why."""
    html, error = html or "", None
    wants = _NAMES if columns is None else columns
    has_text, has_path = "full_text" in wants or "raw_text" in wants, not _PATH_COLUMNS.isdisjoint(wants)
    has_attrs = "attrs" in wants or "classes" in wants
    b = _TreeBuilder(html, tags, keep_strings, has_text, "own_string" in wants)
    try:
        b.feed(html)
        b.finish()
    except Exception as e:  # noqa: BLE001 -- reported in the document node
        error = f"{type(e).__name__}: {e}"
        for el in b.stack:
            b._close(el, len(html))
        b.stack = []
    pieces = b.pieces
    tag_seen: dict[str, int] = {}
    pick = None if columns is None else _picker(tuple(columns))
    if "own_string" in wants:
        _single_strings(b.nodes)
    for node in b.nodes:
        parent, tag = node["parent"], node["tag"]
        if node["kind"] == "element":
            if tags is not None and tag not in tags:
                continue
            tag_seen[tag] = tag_seen.get(tag, 0) + 1
            attrs, classes = node["attrs"], node["classes"]
            if classes is None and has_attrs:
                attrs, classes = _attributes(_PAIRS(attrs)) if attrs else ({}, [])
            full = raw = None
            if has_text and (text_tags is None or parent is None or tag in text_tags):
                lo = node["open_piece"] or 0
                hi = node.get("close_piece", len(pieces))
                want = _wanted_type(tag)
                sel = [pc for pc in pieces[lo:hi] if pc[2] in want]
                full = "".join([pc[0] for pc in sel])
                raw = "".join([pc[1] for pc in sel]) if (with_raw or parent is None) else None
            path, path_tags = _below(parent) if has_path else ((), ())
            source = html[node["src_start"]:min(node["src_end"], node["src_start"] + source_chars)] if source_chars else None
            rec = (page_id, url, node["node_id"], parent["node_id"] if parent else None, len(path), path, path_tags,
                   "element", tag, parent["tag"] if parent else None, attrs, classes,
                   bool(parent) and parent["last"] is node, None, full, raw, node["src_start"], node["src_end"],
                   tag_seen[tag], node.get("single"), source, error if parent is None else None)
        elif keep_strings:
            path, path_tags = _below(parent) if has_path else ((), ())
            rec = (page_id, url, node["node_id"], parent["node_id"], len(path), path, path_tags, node["kind"], None,
                   parent["tag"], None, None, None, node["text"], None, None, None, None, None, None, None, None)
        else:
            continue
        yield rec if pick is None else pick(rec)


_NAMES = [f.name for f in ELEMENT_SCHEMA]
_PATH_COLUMNS = frozenset(["path", "path_tags", "depth"])


@lru_cache
def _picker(columns: tuple):
    """The values of some columns of a whole record; two or more columns."""
    return itemgetter(*[_NAMES.index(c) for c in columns])


def _emit(rows, schema=_ARROW_SCHEMA):
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = []
    for i, field in enumerate(schema):
        vals = list(cols[i])
        if pa.types.is_map(field.type):
            vals = [None if v is None else list(v.items()) for v in vals]
        arrays.append(pa.array(vals, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _parse_batches(batches, with_raw: bool, text_tags=None, keep_strings: bool = True, source_chars: int = 0, tags=None, columns=None,
                   rows_per_batch: int = 5000, chars_per_batch: int = 4_000_000, pages_per_slice: int = 100):
    """A few pages are Python objects at a time, and a batch of nodes ends by its rows or by the html it comes from."""
    schema = _ARROW_SCHEMA if columns is None else pa.schema([_ARROW_SCHEMA.field(c) for c in columns])
    for batch in batches:
        out, chars = [], 0
        for lo in range(0, batch.num_rows, pages_per_slice):
            d = batch.slice(lo, pages_per_slice).to_pydict()
            for pid, url, html in zip(d["page_id"], d["url"], d["html"]):
                chars += len(html or "")
                for rec in parse_html(pid, url, html, with_raw, text_tags, keep_strings, source_chars, tags, columns):
                    out.append(rec)
                    if len(out) >= rows_per_batch:
                        yield _emit(out, schema)
                        out, chars = [], 0
                if out and chars >= chars_per_batch:
                    yield _emit(out, schema)
                    out, chars = [], 0
        if out:
            yield _emit(out, schema)


def element_table(pages: DataFrame, with_raw_text: bool = False, path: str | None = None,
                  persist: bool = True, text_tags=None, keep_strings: bool = True, source_chars: int = 0,
                  tags=None, columns=None) -> DataFrame:
    """H0 for reuse by several extractors, so the Python parse runs once.

    With ``path`` the table is written as parquet (a lineage cut that survives
    lost executors; use a folder under ``spark.checkpoint.dir`` or the
    warehouse) and read back; otherwise it is persisted in memory and disk."""
    from pyspark import StorageLevel
    el = parse_pages(pages, with_raw_text, text_tags=text_tags, keep_strings=keep_strings, source_chars=source_chars, tags=tags, columns=columns)
    if path:
        el.write.mode("overwrite").parquet(path)
        return pages.sparkSession.read.parquet(path)
    return el.persist(StorageLevel.MEMORY_AND_DISK) if persist else el


def parse_pages(pages: DataFrame, with_raw_text: bool = False, text_tags=None,
                keep_strings: bool = True, source_chars: int = 0, tags=None, columns=None) -> DataFrame:
    """H0: the element table of ``pages(page_id, url, html)``.

    Parsing is embarrassingly parallel (no shuffle); output rows stream out in
    bounded Arrow batches.  Persist or write the result when several
    extractors read it.

    At scale pass ``text_tags`` (the tags whose text the extractors read) and
    ``keep_strings=False`` unless visible text is wanted: ancestors such as
    ``body`` would otherwise each carry the page's whole text.  Spark cannot prune what a Python parse
    returns: ``tags`` (elements to return) and ``columns`` (besides page_id, node_id and kind) do, see ``web.READS``."""
    src = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string"))
    tt, tg = (None if t is None else frozenset(t) for t in (text_tags, tags))
    cols = None if columns is None else [c for c in _NAMES if c in {"page_id", "node_id", "kind", *columns}]
    if columns is not None and not set(columns) <= set(_NAMES):
        raise ValueError(f"no such columns: {sorted(set(columns) - set(_NAMES))}")
    schema = ELEMENT_SCHEMA if cols is None else T.StructType([ELEMENT_SCHEMA[c] for c in cols])
    return src.mapInArrow(lambda it: _parse_batches(it, with_raw_text, tt, keep_strings, source_chars, tg, cols), schema)
