"""Approximate nearest neighbours by inner product with small-world graphs (operator 12).

Every shard of vectors gets a hierarchical navigable small-world graph: a node reaches a level with a chance that falls
by ``1 / links`` a level, each level links its nodes to diverse near ones, and a search goes down from the
few nodes of the top level to a beam over the lowest one.  The graph is kept as flat neighbour arrays, one row per shard of a
written table; nodes are numbered by falling level, so a level is the first so many nodes.  Nodes enter a level in
growing batches whose searches advance together in numpy.

The largest inner product is not a metric; with one more component that brings all vectors of a shard to the same length, near
vectors are those of large inner product, and a query with 0 there keeps its products.  Equal vectors
are one node with all their rows, so copies cannot crowd a neighbourhood.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkeda.llm.common import uniform, written

#: Links a node chooses (twice as many are kept on the lowest level), and the beams of building and searching.
LINKS, BUILD_BEAM, BEAM = 16, 64, 192
#: Rows of a shard at the most (recall falls with the rows a beam has to find its way through), and about the least
#: where more shards let more cores build.
SHARD_ROWS, FEW_ROWS = 1 << 14, 1 << 12
#: Queries that meet one copy of a shard.
QUERY_ROWS = 1 << 15
STEP = 512


class Graph:
    """The levels over the rows of ``x`` (vectors of one length, by falling level); ``near[l]`` holds those of level l, -1: none."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray]):
        self.x, self.near = x, near

    @classmethod
    def build(cls, x: np.ndarray, sizes: list[int], links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """``sizes``: nodes of each level, the lowest (all) first."""
        g = cls(x, [np.full((n, links * (1 if level else 2)), -1, np.int32) for level, n in enumerate(sizes)])
        for level in reversed(range(len(sizes))):
            done = 0
            while done < sizes[level]:
                more = np.arange(done, min(sizes[level], done + max(1, min(STEP, done or STEP))))
                g._enter(level, more, done, links, beam)
                done = more[-1] + 1
        return g

    def _enter(self, level: int, more: np.ndarray, done: int, links: int, beam: int) -> None:
        """Link the new nodes with near ones of the ``done`` earlier nodes and among themselves."""
        x, near = self.x, self.near[level]
        same = x[more] @ x[more].T
        np.fill_diagonal(same, -np.inf)
        few = min(len(more), links)
        at = np.argpartition(-same, few - 1, 1)[:, :few]
        sims = np.take_along_axis(same, at, 1)
        ids = np.where(np.isfinite(sims), more[at], -1)  # not itself
        if done:
            start = self._down(x[more], level)
            start[start >= done] = 0
            found, value = self._beam(x[more], start, level, beam)
            ids, sims = np.concatenate([found, ids], 1), np.concatenate([value, sims], 1)
        ids, sims = _best(ids, sims, beam)
        mine = _diverse(x, ids, sims, links)
        near[more, :links] = mine
        # the chosen nodes link back, and choose anew where they have too many links
        k, c = np.nonzero(mine >= 0)
        to, new = mine[k, c], more[k]
        order = np.lexsort((-np.einsum("nd,nd->n", x[to], x[new]), to))
        to, new = to[order], new[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
        for lo in range(0, len(first), STEP):
            hi = min(lo + STEP, len(first))
            a, b = first[lo], (first[hi] if hi < len(first) else len(to))
            nodes, width = to[first[lo:hi]], near.shape[1]
            offer = np.full((hi - lo, width), -1, np.int32)  # the nearest new ones; the others have their own link
            fits = place[a:b] < width
            offer[np.repeat(np.arange(hi - lo), np.diff(np.concatenate([first[lo:hi], [b]])))[fits], place[a:b][fits]] = new[a:b][fits]
            old = near[nodes]
            offer[(offer[:, :, None] == old[:, None, :]).any(2)] = -1
            ids = np.concatenate([old, offer], 1)
            sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", x[nodes], x[ids]), -np.inf)
            ids, sims = _best(ids, sims, 2 * width)
            full = (ids >= 0).sum(1) > width
            near[nodes[~full]] = ids[~full, :width]
            if full.any():
                near[nodes[full]] = _diverse(x, ids[full], sims[full], width)

    def _down(self, q: np.ndarray, level: int) -> np.ndarray:
        """Nodes of the levels above to start from on ``level``."""
        start = np.zeros((len(q), 1), np.int64)
        for up in range(len(self.near) - 1, level, -1):
            start = self._beam(q, start, up, 16)[0][:, :8].astype(np.int64)
            start = np.where(start < 0, 0, start)
        return start

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of a level and their products, best first: all queries expand their best open node at a time."""
        x, near, n = self.x, self.near[level], len(q)
        seen, rows = np.zeros((n, len(near)), bool), np.arange(n)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
        start = np.sort(start, 1)[:, :beam]
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        ids[:, :start.shape[1]] = start
        sims[:, :start.shape[1]] = np.where(start >= 0, np.einsum("nd,nkd->nk", q, x[start]), -np.inf)
        r, c = np.nonzero(start >= 0)
        seen[r, start[r, c]] = True
        is_open = np.zeros((n, beam), bool)
        is_open[:, :start.shape[1]] = start >= 0
        live = rows
        while len(live):
            at = np.argmax(np.where(is_open[live], sims[live], -np.inf), 1)
            go = is_open[live, at]
            live, at = live[go], at[go]
            if not len(live):
                break
            is_open[live, at] = False
            more = near[ids[live, at]]
            fresh = (more >= 0) & ~seen[live[:, None], more]
            some = fresh.any(1)
            rows, more, fresh = live[some], more[some], fresh[some]
            if not len(rows):
                continue
            k, c = np.nonzero(fresh)
            seen[rows[k], more[k, c]] = True
            value = np.full(more.shape, -np.inf, np.float32)
            value[k, c] = np.einsum("nd,nd->n", q[rows[k]], x[more[k, c]])
            all_ids = np.concatenate([ids[rows], np.where(fresh, more, -1)], 1)
            all_sims, all_open = np.concatenate([sims[rows], value], 1), np.concatenate([is_open[rows], fresh], 1)
            keep = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
            is_open[rows] = np.take_along_axis(all_open, keep, 1)
        return _best(ids, sims, beam)

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The nodes of largest product with each query, best first (-1: no more)."""
        out = [self._beam(part, self._down(part, 0), 0, min(beam, len(self.x)))[0]
               for part in (q[k:k + STEP] for k in range(0, len(q), STEP))]
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, 1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Per row up to ``most`` of its nodes (best first): those that are nearer to the row's node than to any
    chosen before, then the best of the others."""
    v = x[ids]
    between = v @ v.transpose(0, 2, 1)
    shut, kept = ids < 0, np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        ok = ~shut[:, c] & (kept.sum(1) < most)
        kept[:, c] = ok
        shut |= ok[:, None] & (between[:, c] > sims)
    rank = np.where(ids < 0, 2 * ids.shape[1], np.where(kept, 0, ids.shape[1])) + np.arange(ids.shape[1])
    out = np.full((len(ids), most), -1, np.int32)
    order = np.argsort(rank, 1)[:, :most]
    out[:, :order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


INDEX = ("shard long, links int, ids array<long>, cuts array<int>, dims int, vectors array<double>, "
         "level_sizes array<int>, neighbours array<int>")


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Ids and vectors as double, without nulls, values that are not finite, and vectors without a component other than zero."""
    v = F.col(f"`{vec_col}`")
    good = (F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.exists(v, lambda c: c != 0)
            & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    return df.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: c.cast("double")).alias("v"))


def _matrix(column) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = c.offsets.to_numpy()
    flat = c.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    if len(n) and (n == n[0]).all():
        return flat[at[0]:at[-1]].reshape(len(n), n[0]) + 0.0  # no negative zeros
    out = np.zeros((len(n), int(n.max(initial=1))))
    for k in range(len(n)):
        out[k, :n[k]] = flat[at[k]:at[k + 1]]
    return out + 0.0


def _fit(x: np.ndarray, dims: int) -> np.ndarray:
    """Cut, or filled up with zeros, to so many components."""
    return x[:, :dims] if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _lifted(x: np.ndarray) -> np.ndarray:
    """Unit vectors with the same order of products: scaled by the longest, and one more component up to its length."""
    scale = np.abs(x).max(initial=0.0) or 1.0
    length = np.sqrt(((x / scale) ** 2).sum(1))
    x = x / scale / length.max(initial=1e-300)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x ** 2).sum(1)))[:, None]], 1).astype(np.float32)


def write_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS,
                links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """The written index: one row per shard of at most about ``shard_rows`` rows (dealt by hash of id and vector).

    Every row with a usable vector is in it.  ``ids`` holds the rows of all nodes, ``cuts`` where each
    node's begin; ``neighbours`` the levels one after another, ``links`` a node above and twice as many on the lowest."""
    x = _usable(vectors, id_col, vec_col)
    spark = x.sparkSession
    n = x.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // FEW_ROWS))
    x = x.withColumn("shard", F.pmod(F.xxhash64(F.lit(12), "id", "v"), F.lit(shards)))

    def build(key, t):
        ids, v = t["id"].to_numpy(), _matrix(t["v"])
        _, node = np.unique(v.view([("", v.dtype)] * v.shape[1]).ravel() if v.shape[1] else np.zeros(len(v)), return_inverse=True)
        one = np.zeros(node.max() + 1, np.int64)
        one[node] = np.arange(len(v))
        # levels by a random draw fixed by the shard; nodes are numbered by falling level
        level = np.floor(-np.log(np.random.default_rng(int(key[0].as_py())).random(len(one))) / math.log(links)).astype(int)
        rank = np.argsort(-level, kind="stable")
        one, level = one[rank], level[rank]
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        node = number[node]
        order = np.lexsort((ids, node))
        sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
        g = Graph.build(_lifted(v[one]), sizes, links, beam)
        rows = {"shard": [key[0].as_py()], "links": [links], "ids": [ids[order]], "dims": [v.shape[1]], "vectors": [v[one].ravel()],
                "cuts": [np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(one)))])], "level_sizes": [sizes],
                "neighbours": [np.concatenate([a.ravel() for a in g.near])]}
        kinds = {"shard": pa.int64(), "links": pa.int32(), "ids": pa.list_(pa.int64()), "cuts": pa.list_(pa.int32()), "dims": pa.int32(),
                 "vectors": pa.list_(pa.float64()), "level_sizes": pa.list_(pa.int32()), "neighbours": pa.list_(pa.int32())}
        names = ["shard", "links", "ids", "cuts", "dims", "vectors", "level_sizes", "neighbours"]
        return pa.table([pa.array(rows[c], kinds[c]) for c in names], names=names)

    return written(x.repartition(shards, "shard").groupBy("shard").applyInArrow(build, INDEX), "graphs")


def _read_graph(row: dict) -> tuple[Graph, np.ndarray]:
    x = np.array(row["vectors"]).reshape(-1, row["dims"])
    near, at = [], 0
    flat = np.array(row["neighbours"], np.int32)
    for level, n in enumerate(row["level_sizes"]):
        width = row["links"] * (1 if level else 2)
        near.append(flat[at:at + n * width].reshape(n, width))
        at += n * width
    return Graph(_lifted(x), near), x


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           index: DataFrame | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of largest inner product found for every query row.

    Scores are sums of products in double over the original vectors, in order of the components.  Every row with another id than the
    query's is a candidate, each of repeated ids too; equal scores go to the smaller id.  Null vectors, vectors that hold a
    null, NaN or infinite component or nothing but zeros, and rows without an id take no part.  Vectors of different
    length are compared over the common components.  Query rows that repeat an id are searched each, so their ranks repeat.
    Which near vectors are found is approximate: a wider ``beam`` finds more.

    A shard's row meets the queries in runs of about ``query_rows``, and one task holds one shard and one run at a time;
    the best of all shards are merged by a window limit."""
    index = write_index(vectors, id_col, vec_col, shard_rows) if index is None else index
    q = written(_usable(queries, id_col, vec_col).withColumn("query", F.monotonically_increasing_id()), "queries")
    shards, m = index.count(), q.count()
    fan = max(1, -(-m // query_rows))
    all_shards = index.select(F.col("shard").alias("to")).distinct()
    left = index.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    right = q.withColumn("run", F.floor(uniform("query", seed=5) * fan).cast("int")).crossJoin(
        F.broadcast(all_shards)).withColumnRenamed("to", "shard")  # one row per shard
    most = max(1, min(shards * fan, 4 * int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def meet(graphs, asked):
        out = [[], [], [], []]
        names = ["query", "query_id", "vec_id", "score"]
        if graphs.num_rows and asked.num_rows:
            row = {c: (graphs[c][0].values.to_numpy() if c in ("ids", "cuts", "vectors", "neighbours", "level_sizes") else graphs[c][0].as_py())
                   for c in graphs.column_names}
            g, x = _read_graph(row)
            row["repeats"] = int(np.unique(row["ids"], return_counts=True)[1].max())
            number, own, v = asked["query"].to_numpy(), asked["id"].to_numpy(), _fit(_matrix(asked["v"]), row["dims"])
            scale = np.abs(v).max(1, initial=1e-300)[:, None]
            lifted = np.concatenate([v / scale, np.zeros((len(v), 1))], 1).astype(np.float32)
            found = g.search(lifted, max(beam, 2 * k))
            for lo in range(0, len(found), STEP):
                part = [a[lo:lo + STEP] for a in (number, own, v, found)]
                for c, value in zip(out, _rows(row, x, *part, k)):
                    c.append(value)
        return pa.table([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(
            out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=names)

    best = (left.repartition(most, "shard", "run").groupBy("shard", "run")
            .cogroup(right.repartition(most, "shard", "run").groupBy("shard", "run"))
            .applyInArrow(meet, "query long, query_id long, vec_id long, score double"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return written(best, "graph-best").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _rows(row: dict, x: np.ndarray, number, own, v, found, k: int) -> tuple:
    """The k best rows of the nodes found for each query, with exact scores."""
    q, c = np.nonzero(found >= 0)
    node = found[q, c]
    score = np.zeros(len(q))
    for d in range(x.shape[1]):  # one component after another, as a plain sum has it
        score = score + v[q, d] * x[node, d]
    order = np.lexsort((-score, q))
    q, node, score = q[order], node[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    near = place < 2 * k
    q, node, score = q[near], node[near], score[near]
    first = row["cuts"][node].astype(np.int64)
    # of a node with many rows the smallest ids are enough: k, and as many as may be the query's own
    count = np.minimum(np.diff(row["cuts"])[node], k + row["repeats"])
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    q, score, ids = np.repeat(q, count), np.repeat(score, count), row["ids"][at]
    other = ids != own[q]
    q, score, ids = q[other], score[other], ids[other]
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return number[q][keep], own[q][keep], ids[keep], score[keep]
