"""Exact top-k search by inner product with MaxScore (operator 1).

Vectors hold integers; a dimension with one sign of the query's component is a query term,
its postings are the vectors whose component is not zero there, and the largest product in a
shard bounds what the term can add.  Terms are split by these bounds: as long as the bounds
of the weakest terms sum to less than the k-th best score so far, a vector found in none of
the other (essential) postings cannot enter the result.  Essential postings are traversed in
blocks of vectors; the rest are probed strongest first, for those vectors only that can still
compete.  Shards of vectors meet blocks of queries, and the best of every shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkeda.llm.common import written

#: Rows of a shard and of a block of queries at the most, and of a shard at the least where more shards let more cores work.
SHARD_ROWS, QUERY_ROWS, FEW_ROWS = 1 << 16, 1 << 14, 1 << 12
#: Tasks that share the pairs of shards and blocks, at the most.
TASKS = 4096


class Shard:
    """Vectors of one shard: rows in order of id, so that ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = 4096):
        order = np.argsort(ids, kind="stable")
        self.ids, self.block = ids[order], block
        self.x = np.ascontiguousarray(vectors[order].T)  # one row of postings per dimension
        self.top, self.low = (self.x.max(1), self.x.min(1)) if len(ids) else (np.zeros(len(self.x)), np.zeros(len(self.x)))
        self.block_top = [(b, self.x[:, b:b + block].max(1), self.x[:, b:b + block].min(1)) for b in range(0, len(ids), block)]

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best ``(score, id)`` of the shard, ``own`` left out, ties to the smaller id."""
        heap: list[tuple[int, int]] = []
        for at, top, low in self.block_top:
            full = len(heap) == k
            floor = heap[-1][0] if full else None
            bound = np.maximum(np.maximum(query * top, query * low), 0)  # a vector outside a posting adds nothing
            order = np.argsort(-bound, kind="stable")
            rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # rest[j]: what terms j.. can add
            # rows come in order of id: an equal score of a later row loses, so it must beat the floor
            n_essential = len(order) if not full else int(np.searchsorted(-rest, -floor, side="left"))
            if full and rest[0] <= floor:
                continue
            x = self.x[:, at:at + self.block]
            essential = order[:n_essential]
            step = max(1, len(essential) // 4)
            # below zero even a vector outside all postings competes
            rows = None if not full or floor < 0 else np.flatnonzero((x[essential] != 0).any(0))
            score = np.zeros(x.shape[1] if rows is None else len(rows), x.dtype)
            done = 0
            while done < len(order):
                part = order[done:done + step] if done < n_essential else order[done:done + 4]
                got = query[part] @ (x[part] if rows is None else x[np.ix_(part, rows)])
                score = score + got
                done += len(part)
                if full:
                    alive = score + rest[done] > floor
                    if not alive.all():
                        rows, score = (np.flatnonzero(alive) if rows is None else rows[alive]), score[alive]
                        if not len(rows):
                            break
            if rows is None:
                rows = np.arange(x.shape[1])
            ids = self.ids[at + rows]
            ok = ids != own
            rows_score, ids = score[ok], ids[ok]
            if len(ids) > k:  # the k best and all that tie with the last of them
                cut = np.partition(rows_score, len(rows_score) - k)[len(rows_score) - k]
                few = rows_score >= cut
                rows_score, ids = rows_score[few], ids[few]
            heap = sorted([*heap, *zip(map(int, rows_score), map(int, ids))], key=lambda h: (-h[0], h[1]))[:k]
        return heap


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors padded with zeros to one length; exact in double where no sum can pass 2**53."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        a = np.frombuffer(v, np.float64)
        out[k, :len(a)] = a
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    return not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 256.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k vectors of highest inner product for every query.

    Components count as ``floor(scale * x)``.  Every row but the query's own (by id) is a
    candidate; equal scores go to the smaller id.  Vectors that are null or hold a null, NaN or
    infinite component, and rows without an id, take no part; an empty vector scores 0 with all.
    Vectors of different length are compared over the common dimensions.  Rows that repeat an id
    are candidates each; queries that repeat one count once, with the smallest vector.  Components and scores beyond a long are cut to its range.

    Shards of about ``shard_rows`` vectors (by hash of id and vector) meet blocks of about
    ``query_rows`` queries; both are shuffled to their pair, so neither side is ever broadcast
    or held whole.  A task takes a run of pairs, at most ``TASKS`` do, and each holds one shard and one block at a time."""
    def usable(df):
        v = F.col(vec_col)
        good = (F.col(id_col).isNotNull() & v.isNotNull()
                & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(
            v, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double") if scale is not None else c.cast("double")).alias("v"))

    x, q = usable(vectors), usable(queries)
    n, m = x.count(), q.count()
    cores = x.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // shard_rows), min(cores, n // FEW_ROWS)), max(1, -(-m // query_rows))
    pair = (F.col("shard") * F.lit(blocks) + F.col("block")).alias("pair")
    left = x.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(pair, F.lit(1).alias("side"), "id", "v")
    right = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(pair, F.lit(0).alias("side"), "id", "v")

    def meet(at, rows):
        out = []
        ids = {0: [], 1: []}
        vecs = {0: [], 1: []}
        for side, i, v in rows:
            if side == 1 or not ids[side] or ids[side][-1] != i:  # sorted: queries that repeat an id follow each other
                ids[side].append(i)
                vecs[side].append(v)
        dims = max([1, *(len(v) // 8 for s in (0, 1) for v in vecs[s])])
        a, b = _matrix(vecs[0], dims), _matrix(vecs[1], dims)
        if not _exact(a, b):
            a, b = (np.array([[int(c) for c in r] for r in z], object).reshape(-1, dims) for z in (a, b))
        shard = Shard(np.array(ids[1], np.int64), b)
        for i, v in zip(ids[0], a):
            out += [(i, d, s) for s, d in shard.best(v, i, k)]
        return out

    def batch(found):
        low, high = -(1 << 63), (1 << 63) - 1
        cols = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                           pa.array([min(high, max(low, s)) for s in cols[2]], pa.int64())],
                                          names=["query_id", "vec_id", "score"])

    def run(batches):
        at, rows = None, []
        for b in batches:
            flat = b.column(3)
            for p, side, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), flat):
                if p != at:
                    if rows:
                        yield batch(meet(at, rows))
                    at, rows = p, []
                rows.append((side, i, v.values.to_numpy(zero_copy_only=False).tobytes()))
        if rows:
            yield batch(meet(at, rows))

    both = left.unionByName(right).repartitionByRange(min(shards * blocks, TASKS), "pair").sortWithinPartitions("pair", "side", "id", "v")
    best = written(both.mapInArrow(run, "query_id long, vec_id long, score long"), "search-shards")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
