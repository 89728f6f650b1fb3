"""Substring dedup by paragraph MinHash banding and exact windows (operator 6).

The units of a text are its paragraphs (lines, and blocks of lines between blank lines) and windows of ``words``
words.  Bands of MinHash values over a paragraph's five-word shingles meet in a shuffle; paragraphs that collide
across documents are verified by exact Jaccard similarity, and connected ones form a component.  Windows take care
of passages that are no paragraph of their own: of every ``spread`` consecutive shingles the one with the smallest hash
starts a window, and equal windows meet by their hash.  So texts that share ``words + spread - 1`` words share a
window, and a passage of 26 words or more that is similar at 0.8 holds as long an exact run.  Around the windows found,
all window positions are compared, which takes each exact run to its ends; runs that lie in the same
order in two documents join over edits while the whole stays similar.

The smallest document that has a unit keeps it.  What a document keeps for any unit stays in it, whatever else it shares with
a smaller one, so every window and paragraph that is found twice stays whole in some text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import dropped, runs, scratch
from sparkeda.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
WORDS, SPREAD = 20, 5
LEAST_WORDS = 8
#: Members of a bucket that one task compares with each other at a time, and shingles of theirs.
BLOCK, COLUMNS = 256, 1 << 14
_ROLL, _SEQ = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C55)
_SEQ_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_SALTS = 63
#: Stretches of keys that a task settles one after the other.
STRETCHES = 4


def tune_bands(similarity: float = SIMILARITY, recall: float = 0.98, rows: int = 2) -> int:
    """The fewest bands of ``rows`` values that join a pair at ``similarity`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sliding(best, x: np.ndarray, size: int) -> np.ndarray:
    """``best`` over every ``size`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= size:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[:len(x) - (size - width)], x[size - width:])


class Units:
    """The units of some texts, as ranges of words of all texts in a row.

    Words are between ASCII white space, A-Z lower-cased.  Paragraphs have ``LEAST_WORDS`` words or more; a text of fewer
    than ``words`` words is one too.  ``first`` has the first word of each text and, at the end, the number of words."""

    def __init__(self, texts: list[str | None], words: int = WORDS, spread: int = SPREAD):
        self.words, self.spread = words, spread
        flat, lines, first = [], [], [0]  # lines: the words of each line, -1 after a text
        for t in texts:
            for line in (t or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
                w = line.split()
                flat += w
                lines.append(len(w))
            lines.append(-1)
            first.append(len(flat))
        n = len(flat)
        self.first = np.array(first)
        h = np.zeros(n + SHINGLE, np.uint64)
        h[:n] = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, n)
        g = h[:n + 1].copy()
        for k in range(1, SHINGLE):
            g = g * _ROLL + h[k:n + 1 + k]
        self.shingles = g = _mix(g)  # those that reach over a text's end are in no unit
        with np.errstate(over="ignore"):
            self._power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, _SEQ)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _SEQ_INVERSE)]))
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(g * down)])
        size = np.array(lines, np.int64)
        ends = np.cumsum(np.maximum(size, 0))
        starts = ends - np.maximum(size, 0)
        open_ = np.concatenate([[False], size > 0, [False]])
        block = np.flatnonzero(open_[1:] != open_[:-1])
        short = np.flatnonzero(np.diff(self.first) < words)
        spans = np.concatenate([np.stack([starts, ends], 1), np.stack([starts[block[::2]], ends[block[1::2] - 1]], 1),
                                np.stack([self.first[short], self.first[short + 1]], 1)])
        self.paragraphs = np.unique(spans[spans[:, 1] - spans[:, 0] >= LEAST_WORDS], axis=0)

    def hashes(self, spans: np.ndarray) -> np.ndarray:
        """One hash per span, of its shingles in order (``sum of shingle[i] * SEQ ** (last - i)``)."""
        a, b = spans[:, 0], spans[:, 1] - (SHINGLE - 1)
        return _mix(self._power[b - 1] * (self._sums[b] - self._sums[a]))

    def texts(self, spans: np.ndarray) -> np.ndarray:
        """The number of the text of each span."""
        return np.searchsorted(self.first, spans[:, 0], "right") - 1

    def fits(self) -> np.ndarray:
        """For each word: whether a window may begin there."""
        out = np.zeros(len(self.shingles), bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            out[a:max(a, b - self.words + 1)] = True
        return out

    def windows(self) -> np.ndarray:
        """The windows whose first shingle is the smallest of some ``spread`` in a row, and the last of each text."""
        top = np.full(self.spread - 1, ~np.uint64(0))
        rank = np.concatenate([top, np.where(self.fits(), self.shingles, ~np.uint64(0)), top])
        low = _sliding(np.minimum, rank, self.spread)
        # the smallest of some window: as large as the largest minimum of the windows that hold it
        rank = rank[len(top):len(rank) - len(top)]
        chosen = (rank == _sliding(np.maximum, low, self.spread)) & self.fits()
        chosen[self.first[1:][np.diff(self.first) >= self.words] - self.words] = True
        at = np.flatnonzero(chosen)
        return np.stack([at, at + self.words], 1)

    def near(self, text: np.ndarray, at: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """The windows that begin less than ``spread`` words from one that begins in its ``text`` at word ``at`` (both rising), without those
        and without the ones between two that are ``linked`` (one value per gap)."""
        d = np.arange(1, self.spread)
        left, right = np.concatenate([[True], ~linked]), np.concatenate([~linked, [True]])
        near = np.concatenate([(at[left][:, None] - d).ravel(), (at[right][:, None] + d).ravel()])
        mine = np.concatenate([np.repeat(text[left], len(d)), np.repeat(text[right], len(d))])

        def inside(text, at):
            fit = (at >= 0) & (at + self.words <= np.diff(self.first)[text])
            return self.first[text[fit]] + at[fit]

        near = np.setdiff1d(inside(mine, near), inside(text, at))
        return np.stack([near, near + self.words], 1)


def band_keys(shingles: np.ndarray, spans: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per span of words and band (columns)."""
    rng = np.random.default_rng(6)
    xor, odd = rng.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
    out = np.zeros((len(spans), bands), np.uint64)
    if not len(spans):
        return out
    ranges = (spans - [0, SHINGLE - 1]).ravel()
    for k in range(bands * rows):
        low = np.minimum.reduceat(_mix((shingles ^ xor[k]) * (odd[k] | np.uint64(1))), ranges)[::2]
        out[:, k // rows] = _mix(out[:, k // rows] * _SEQ + low + np.uint64(k))
    return out


def _band_rows(docs: DataFrame, bands: int, rows: int, tasks: int) -> DataFrame:
    """Lists of ``key, class, doc, meta, size`` per window, and per paragraph and band; the key of a window is its class.

    Rows of a key that several documents share within one run of texts are known to collide: one of them keeps
    salt 0 and meets the key's other rows, the rest (salt > 0) need no meeting and are dealt out evenly.  A run of texts
    gives one row per ``task`` (of ``tasks``) and ``stretch`` of that task's keys, with all units that go there."""
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in runs(texts, 4 << 20):
                units = Units(texts[lo:hi])
                windows, blocks = units.windows(), units.paragraphs
                spans = np.concatenate([windows, np.repeat(blocks, bands, 0)])
                if not len(spans):
                    continue
                cls = units.hashes(spans)
                key = np.concatenate([cls[:len(windows)], band_keys(units.shingles, blocks, bands, rows).ravel()])
                text = units.texts(spans)
                doc, pos, size = ids[lo:hi][text], spans[:, 0] - units.first[text], spans[:, 1] - spans[:, 0]
                order = np.lexsort((doc, key))
                key, cls, doc, pos, size = key[order], cls[order], doc[order], pos[order], size[order]
                first = np.concatenate([[True], key[1:] != key[:-1]])
                group = np.cumsum(first) - 1
                starts = np.flatnonzero(first)
                ends = np.append(starts[1:], len(key)) - 1
                known = (doc[ends] != doc[starts])[group]
                place = np.arange(len(key)) - starts[group]
                salt = np.where(known & (place > 0), 1 + place % _SALTS, 0)
                meta = pos * 128 + salt + np.where(known, 64, 0)
                to = np.where(salt > 0, _mix(key + salt.astype(np.uint64) * _SEQ), key) >> np.uint64(32)
                to = (to * np.uint64(tasks * STRETCHES) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to = to[order]
                cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                at = pa.array(np.append(cuts, len(to)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((to[cuts] // STRETCHES).astype(np.int32)), pa.array((to[cuts] % STRETCHES).astype(np.int32)),
                     *(pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (key.view(np.int64), cls.view(np.int64), doc, meta, size))],
                    names=["task", "stretch", "key", "class", "doc", "meta", "size"])

    lists = ", ".join(f"{c} array<long>" for c in ("key", "class", "doc", "meta", "size"))
    return docs.mapInArrow(run, f"task int, stretch int, {lists}")


def _colliding(key, cls, doc, meta, size) -> list[np.ndarray]:
    """``key, class, doc, size, pos`` of the units whose key is known to collide or stands in two documents here."""
    salted = np.flatnonzero(meta % 64 > 0)
    meets = np.flatnonzero(meta % 64 == 0)
    meets = meets[np.argsort(key[meets], kind="stable")]
    k, d, known = key[meets], doc[meets], meta[meets] // 64 % 2
    if len(meets):
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        hit = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        hit |= np.maximum.reduceat(known, first) > 0
        meets = meets[np.repeat(hit, np.diff(np.append(first, len(k))))]
    take = np.concatenate([salted, meets])
    return [key[take], cls[take], doc[take], size[take], meta[take] // 128]


def collisions(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``key, class, doc, size, pos`` of the units whose key occurs in two documents or more.

    ``docs`` has ``doc`` and ``text``.  One shuffle by key; a task settles its keys in stretches, one after the other, so it
    holds one stretch of ``STRETCHES`` of them at a time."""
    names = ["key", "class", "doc", "size", "pos"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_ = _band_rows(docs, bands, rows, tasks).repartitionById(tasks, F.col("task")).sortWithinPartitions("stretch").drop("task")

    def settled(parts):
        cols = [np.concatenate([p.column(k).flatten().to_numpy() for p in parts]) for k in range(1, 6)]
        return pa.RecordBatch.from_arrays([*map(pa.array, _colliding(*cols))], names=names)

    def run(batches):
        at, parts = None, []
        for b in batches:
            stretch = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(stretch)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if parts and stretch[i] != at:
                    yield settled(parts)
                    parts = []
                at = stretch[i]
                parts.append(b.slice(i, j - i))
        if parts:
            yield settled(parts)

    return rows_.mapInArrow(run, "key long, class long, doc long, size long, pos long")


def _similar(members: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Edges ``(class, class)`` that connect what is similar among the members, one less than members at most
    for each connected part."""
    n = len(members)
    if n == 2:
        a, b = (set(m[1].tolist()) for m in members)
        return [(members[0][0], members[1][0])] if len(a & b) >= similarity * len(a | b) - 1e-6 else []
    codes = np.unique(np.concatenate([m[1] for m in members]), return_inverse=True)[1]
    size = np.array([len(m[1]) for m in members])
    owner = np.repeat(np.arange(n), size)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for low in range(0, int(codes[-1]) + 1, COLUMNS):  # few columns at a time: long paragraphs have many shingles
        a, b = np.searchsorted(codes, [low, low + COLUMNS])
        has = np.zeros((n, int(codes[b - 1]) - low + 1), np.float32)
        has[owner[a:b], codes[a:b] - low] = 1
        both += has @ has.T
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    part = np.arange(n)
    out = []
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        x, y = int(part[a]), int(part[b])
        if x != y:
            part[part == max(x, y)] = min(x, y)
            out.append((members[a][0], members[b][0]))
    return out


def verified(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``(u, v)``: edges between different classes of paragraphs that share a key and are similar; ``(class, shingles)``
    of the classes that were compared; and the tables that the edges are read from.

    ``found`` is a written result of ``collisions``.  Only buckets with several classes need it; one document
    per class gives the shingles.  A bucket of many classes is cut into blocks, and each pair of blocks is a task's
    group of its own, of ``2 * BLOCK`` members or so."""
    classes = scratch(found.where("key <> class").groupBy("key", "class").agg(F.min("doc").alias("doc")), "passages-classes")
    several = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    open_ = scratch(classes.join(several, "key"), "passages-open")
    dropped(classes)
    wanted = open_.groupBy("class").agg(F.min("doc").alias("doc")).groupBy("doc").agg(
        F.collect_list("class").alias("classes"))  # a document's own paragraphs

    def fetch(batches):
        for b in batches:
            cls, sh = [], []
            for t, want in zip(b.column(0), b.column(1)):
                units = Units([t.as_py()])
                h = units.hashes(units.paragraphs).view(np.int64)
                for k in np.flatnonzero(np.isin(h, want.values.to_numpy())):
                    lo, hi = units.paragraphs[k]
                    cls.append(h[k])
                    sh.append(units.shingles[lo:hi - SHINGLE + 1].view(np.int64))
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cls)), pa.array(sh, pa.list_(pa.int64()))], names=["class", "shingles"])

    texts = docs.join(wanted, "doc").select("text", "classes").mapInArrow(fetch, "class long, shingles array<long>")
    texts = scratch(texts.groupBy("class").agg(F.first("shingles").alias("shingles")), "passages-shingles")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    deal = open_.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("m")).cast("int"))
    deal = deal.join(texts, "class").select("key", "class", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    deal = deal.select("key", F.least("own", "x").alias("a"), F.greatest("own", "x").alias("b"), "class", "shingles")
    deal = deal.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches):
        at, members = None, []

        def out(edges):
            u, v = list(zip(*edges)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            edges: list = []
            head = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            for (*g, c), s in zip(head, b.column(4)):
                if g != at:
                    if len(members) > 1:
                        edges += _similar(members, similarity)
                    at, members = g, []
                members.append((c, s.values.to_numpy()))
            if edges:
                yield out(edges)
        if len(members) > 1:
            yield out(_similar(members, similarity))

    return deal.mapInArrow(run, "u long, v long"), texts, [open_]


def _common(texts: DataFrame, found: DataFrame, comp: DataFrame) -> DataFrame:
    """``class, component, lead, tail``: the words of a similar paragraph from its first shingle that its component has in
    another document to its last."""
    owners = found.join(comp, F.col("class") == F.col("node")).groupBy("class", "component").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    each = texts.join(owners, "class").select("component", "class", "a", "b", F.posexplode("shingles").alias("at", "shingle"))
    both = each.groupBy("component", "shingle").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").drop("a", "b")
    return each.join(both, ["component", "shingle"]).groupBy("class", "component").agg(
        F.min("at").cast("long").alias("lead"), (F.max("at") + SHINGLE).cast("long").alias("tail"))


def _window_keepers(found: DataFrame) -> DataFrame:
    """``class, keeper, kept``: the first place of each window that was found."""
    return found.where("key = class").groupBy("class").agg(F.min(F.struct("doc", "pos")).alias("lo")).select(
        "class", F.col("lo.doc").alias("keeper"), F.col("lo.pos").alias("kept"))


def _around(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``class, doc, pos, size`` of the windows near those of ``found``, which it lacks.

    Two windows less than ``SPREAD`` words apart that one keeper has as far apart are part of one run, so their keeper
    has all windows between them as well: those are left out.  So a run gives windows at its ends only."""
    kept = found.where("key = class").select("class", "doc", "pos").join(_window_keepers(found), "class")
    at = kept.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "keeper", "kept"))).alias("at"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, hi in runs(texts, 4 << 20):
                at = b.column(2).slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), at.value_lengths().to_numpy())
                pos, keeper, kept = (x.to_numpy() for x in at.flatten().flatten())
                step = np.diff(pos)
                linked = (step <= SPREAD) & (keeper[1:] == keeper[:-1]) & (np.diff(kept) == step) & (text[1:] == text[:-1])
                units = Units(texts[lo:hi])
                spans = units.near(text, pos, linked)
                if len(spans):
                    mine = units.texts(spans)
                    yield pa.RecordBatch.from_arrays([pa.array(units.hashes(spans).view(np.int64)), pa.array(ids[lo:hi][mine]),
                                                      pa.array(spans[:, 0] - units.first[mine]), pa.array(spans[:, 1] - spans[:, 0])],
                                                     names=["class", "doc", "pos", "size"])

    return docs.join(at, "doc").select("doc", "text", "at").mapInArrow(run, "class long, doc long, pos long, size long")


def join_spans(units: list[tuple[int, int, int, int]], similarity: float | None) -> list[tuple[int, int]]:
    """The spans ``(start, end)`` that units ``(start, end, start in the keeper, end in the keeper)`` make up.

    Units that meet or overlap join.  With ``similarity``, spans in the same order in both documents join over
    what differs between them if the shingles of the whole stay as similar."""
    spans: list[list[int]] = []  # start, end, start and end in the keeper, common shingles
    for s, e, ks, ke in sorted(units):
        if spans and s <= spans[-1][1]:
            if e > spans[-1][1]:
                spans[-1][1], spans[-1][3] = e, ke
        else:
            spans.append([s, e, ks, ke, 0])
    out: list[list[int]] = []
    for x in spans:
        x[4] = max(0, x[1] - x[0] - SHINGLE + 1)
        while out and similarity is not None and x[2] >= out[-1][3]:
            p = out[-1]
            common = p[4] + x[4]
            if common < similarity * (x[1] - p[0] + x[3] - p[2] - 2 * (SHINGLE - 1) - common) - 1e-6:
                break
            x = [p[0], x[1], p[2], x[3], common]
            out.pop()
        out.append(x)
    return [(x[0], x[1]) for x in out]


def _without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of some spans lies in none of the ``kept`` ones; both in order and without overlaps."""
    out, j = [], 0
    for s, e in spans:
        while j < len(kept) and kept[j][1] <= s:
            j += 1
        k = j
        while k < len(kept) and kept[k][0] < e:
            if s < kept[k][0]:
                out.append((s, kept[k][0]))
            s = kept[k][1]
            k += 1
        if s < e:
            out.append((s, e))
    return out


def _joined(doc, keeper, start, end, kept, kept_end) -> list[np.ndarray]:
    """The units of each document and keeper, joined where they meet or overlap as in ``join_spans``."""
    order = np.lexsort((kept_end, kept, end, start, keeper, doc))
    doc, keeper, start, end, kept, kept_end = (x[order] for x in (doc, keeper, start, end, kept, kept_end))
    if not len(doc):
        return [doc, keeper, start, end, kept, kept_end]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keeper[1:] != keeper[:-1])])
    base = (np.cumsum(other) - 1) * (int(end.max()) + 1)  # so that a group's words come after those of the group before
    reach = np.maximum.accumulate(base + end)
    so_far = np.concatenate([[-1], reach[:-1]])
    new = other | (base + start > so_far)
    farther = np.maximum.accumulate(np.where(new | (base + end > so_far), np.arange(len(doc)), 0))  # the unit that reaches so far
    first = np.flatnonzero(new)
    last = farther[np.append(first[1:], len(doc)) - 1]
    return [doc[first], keeper[first], start[first], end[last], kept[first], kept_end[last]]


def _doc_spans(units: list[tuple[int, int, int, int, int, bool]], doc: int, similarity: float) -> list[tuple[int, int, int]]:
    """``(keeper, start, end)`` from one document's ``(keeper, start, end, start in the keeper, end in the keeper, exact)``.

    What the document keeps is taken out of the spans that others keep."""
    by_keeper: dict = {}
    for keeper, s, e, kept, kept_end, exact in units:
        by_keeper.setdefault(keeper, ([], []))[0 if exact else 1].append((s, e, kept, kept_end))
    own: list = []
    out = []
    for keeper, (same, similar) in sorted(by_keeper.items(), key=lambda x: x[0] != doc):
        spans = join_spans(same, None if keeper == doc else similarity) + [x[:2] for x in similar]
        spans = join_spans([(*x, 0, 0) for x in spans], None)
        if keeper == doc:
            own = spans
        out += [(keeper, *x) for x in (spans if keeper == doc else _without(spans, own))]
    return out


def _spans(units: DataFrame, similarity: float) -> DataFrame:
    """``doc, keeper, start, end`` from ``doc, keeper, pos, size, kept, exact`` (``kept``: the position in the keeper)."""
    lists = units.groupBy("doc").agg(F.collect_list(F.struct("keeper", "pos", "size", "kept", "exact")).alias("units"))

    def run(batches):
        for b in batches:
            rows, n = [], b.column(1).value_lengths().to_numpy()
            keeper, start, size, kept, exact = (x.to_numpy(zero_copy_only=False) for x in b.column(1).flatten().flatten())
            units = [np.repeat(np.arange(len(n)), n), keeper, start, start + size, kept, kept + size]
            same, similar = _joined(*(x[exact] for x in units)), [x[~exact] for x in units]
            exact = np.repeat([True, False], [len(same[0]), len(similar[0])])
            doc, *units = [np.concatenate(x) for x in zip(same, similar)]
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(len(n) + 1)).tolist()
            units = list(zip(*(x[order].tolist() for x in (*units, exact))))
            for doc, i, j in zip(b.column(0).to_pylist(), cuts, cuts[1:]):
                rows += [(doc, *x) for x in _doc_spans(units[i:j], doc, similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "keeper", "start", "end"])

    return lists.mapInArrow(run, "doc long, keeper long, start long, end long")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.98, rows: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per longest span that is made up of what one other document has too:
    ``doc_id, start_word, end_word, keeper_id, removed``.

    ``keeper_id`` is the smallest id that has the span's units (of a window at the very end of a run, the smallest in whose text it is one
    that its shingles choose); ``removed`` is true in the other
    documents.  Words that a document keeps for another unit are not in its removed spans, so after ``cut_passages`` every window
    and paragraph that was found in two documents is whole in its keeper; of passages that are similar, one stays.  Word positions count words between ASCII white space from 0, the end is exclusive.  Rows with one id
    (or with none) are one document, so a repetition within it is left alone; null, empty and very short texts have no
    unit.  Every exact passage of ``WORDS + SPREAD - 1`` words or more is found for certain and to its ends, wherever it
    stands; ``recall`` is for pairs of lines or blocks at ``similarity``."""
    none = -(1 << 63)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("doc"), F.col(text_col).alias("text"))
    found = scratch(collisions(d, tune_bands(similarity, recall, rows), rows), "passages-found")
    edges, texts, compared = verified(d, found, similarity)
    comp = connected_components(edges, "passages-links", tidy=True)
    dropped(*compared)
    # a window has one row already; a paragraph one for each key that it shares
    blocks = found.where("key <> class").select("class", "doc", "pos", "size").distinct()
    around = _around(d, found).withColumn("first", F.lit(False))
    units = found.where("key = class").select("class", "doc", "pos", "size").unionByName(blocks).withColumn("first", F.lit(True)).unionByName(around)
    units = scratch(units, "passages-units")
    like = units.join(_common(texts, found, comp), "class").select(
        "component", "doc", (F.col("pos") + F.col("lead")).alias("pos"), (F.col("tail") - F.col("lead")).alias("size"), F.lit(False).alias("exact"))
    like = scratch(like, "passages-like")
    dropped(found, texts, comp)
    units_ = units.select(F.col("class").alias("component"), "doc", "pos", "size", F.lit(True).alias("exact"), "first").unionByName(
        like.withColumn("first", F.lit(True)))
    # windows that were found keep the keeper that their runs were told by; the ones around them have one of their own
    place = F.struct("doc", "pos")
    ends = units_.groupBy("component", "exact").agg(F.min(F.when(F.col("first"), place)).alias("told"), F.min(place).alias("lo"), F.max("doc").alias("hi"))
    ends = ends.where("lo.doc < hi").withColumn("lo", F.coalesce("told", "lo"))
    ends = scratch(ends.select("component", "exact", F.col("lo.doc").alias("keeper"), F.col("lo.pos").alias("kept")), "passages-keepers")
    out = scratch(_spans(units_.join(ends, ["component", "exact"]).select("doc", "keeper", "pos", "size", "kept", "exact"), similarity), "passages-spans")
    dropped(units, like, ends)
    return out.select(
        F.nullif("doc", F.lit(none)).alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        F.nullif("keeper", F.lit(none)).alias("keeper_id"), (F.col("doc") != F.col("keeper")).alias("removed"))


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of removed spans (the white space after them goes too); other columns unchanged."""
    gone = passages.where("removed").groupBy(F.struct(F.col("doc_id")).alias("_llm_key")).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("_llm_gone"))
    src = docs.withColumn("_llm_key", F.struct(F.col(id_col).cast("long").alias("doc_id"))).join(gone, "_llm_key", "left")
    keep = F.expr(r"regexp_extract_all(%s, '([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*|^[\\x20\\x09-\\x0D]+)', 1)" % f"`{text_col}`")
    lead = F.when(F.col(text_col).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    src = src.withColumn("_llm_words", keep).withColumn("_llm_lead", lead)
    left = F.expr("array_join(filter(_llm_words, (w, i) -> NOT exists(_llm_gone, g -> i - _llm_lead >= g.start_word AND i - _llm_lead < g.end_word)), '')")
    return src.withColumn(text_col, F.when(F.col("_llm_gone").isNull(), F.col(text_col)).otherwise(left)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
