"""K-means with many starts at once.

All (k, start) models move together: one pass over the vectors finds every row's nearest centre in every model
and adds up, per task, the vectors of each centre; one aggregate merges these sums.  What travels is one
vector per centre and task, what reaches the driver one per centre; a model whose centres stand still drops out of
the next pass.  Seeding is done for all starts together as well, by k-means|| rounds over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

#: Rows whose distances to all centres are held at a time, as cells of the matrix.
CELLS = 1 << 22
#: Rows of sums (one per task and centre) that the driver adds up itself; more are aggregated on the cluster first.
FEW_SUMS = 1 << 11


@dataclass
class Clusters:
    """A fitted model: its centres and their inertia (sum of squared distances of the rows to their centre)."""

    centers: np.ndarray
    inertia: float
    start: int

    @property
    def k(self) -> int:
        return len(self.centers)

    def transform(self, df: DataFrame, features: str = "features", out: str = "Cluster") -> DataFrame:
        """``df`` with the number of the nearest centre; equal distances go to the lower number."""
        centers = self.centers

        @F.pandas_udf("int")
        def nearest(v):
            import pandas as pd

            return pd.Series(_nearest(np.stack(v.to_numpy()), centers, [0, len(centers)])[0][:, 0] if len(v) else [], dtype="int32")

        return df.withColumn(out, nearest(_array(df, features)))


def _array(df: DataFrame, features: str):
    """The feature column as an array of doubles, from a vector or an array column."""
    col = F.col(f"`{features}`")
    return col.cast("array<double>") if df.schema[features].dataType.typeName() == "array" else vector_to_array(col)


def _nearest(x: np.ndarray, centers: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row and model (centres ``cuts[m]`` to ``cuts[m + 1]``) the nearest centre and its squared distance."""
    at, cost = np.empty((len(x), len(cuts) - 1), np.int64), np.empty((len(x), len(cuts) - 1))
    norm = (centers ** 2).sum(1)
    step = max(1, CELLS // max(1, len(centers)))
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        d = norm - 2 * (part @ centers.T)
        for m in range(len(cuts) - 1):
            one = d[:, cuts[m]:cuts[m + 1]]
            best = one.argmin(1)
            at[lo:lo + step, m] = best
            # the distance itself is taken again without cancellation
            cost[lo:lo + step, m] = ((part - centers[cuts[m] + best]) ** 2).sum(1)
    return at, cost


def _rows(batch) -> np.ndarray:
    col = batch.column(0)
    flat, cuts = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return flat[cuts[0]:cuts[-1]].reshape(len(col), -1)


def _move(vectors: DataFrame, centers: np.ndarray, cuts: list[int], tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over ``tasks`` partitions: rows and vector sum of every centre of every model, and the inertia of every model."""
    held = vectors.sparkSession.sparkContext.broadcast((centers, cuts))  # models x k vectors

    def run(batches):
        c, at = held.value
        n, sums, cost = np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(at) - 1)
        for b in batches:
            x = _rows(b)
            if not len(x):
                continue
            near, dist = _nearest(x, c, at)
            cost += dist.sum(0)
            for m in range(len(at) - 1):
                size = at[m + 1] - at[m]
                n[at[m]:at[m + 1]] += np.bincount(near[:, m], minlength=size)
                sums[at[m]:at[m + 1]] += (near[:, m][None, :] == np.arange(size)[:, None]).astype(float) @ x
        costs = np.zeros(len(c))
        costs[np.asarray(at[:-1])] = cost  # a model's inertia stands at its first centre
        rows = np.column_stack([n, costs, sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.FixedSizeListArray.from_arrays(
            pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))], names=["slot", "v"])

    total = vectors.mapInArrow(run, "slot long, v array<double>")
    if tasks * len(centers) > FEW_SUMS:  # then one row per centre
        total = total.groupBy("slot").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    rows = total.toArrow()
    out = np.zeros((len(centers), centers.shape[1] + 2))
    if rows.num_rows:
        np.add.at(out, rows["slot"].to_numpy(), rows["v"].combine_chunks().values.to_numpy().reshape(rows.num_rows, -1))
    return out[:, 0], out[:, 2:], out[np.asarray(cuts[:-1]), 1]


def _farther(vectors: DataFrame, chosen: list[np.ndarray], take: int, seed: int, step: int) -> list[np.ndarray]:
    """For every start, ``take`` rows drawn without replacement in proportion to their squared distance to its chosen rows.

    A row's key is an exponential draw over its distance; the smallest keys of every task are merged by a window limit."""
    cuts = np.cumsum([0, *map(len, chosen)]).tolist()
    held = vectors.sparkSession.sparkContext.broadcast((np.concatenate(chosen), cuts))

    def run(batches):
        c, at = held.value
        rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        best = [(np.zeros(0), np.zeros((0, c.shape[1])))] * (len(at) - 1)
        for b in batches:
            x = _rows(b)
            if not len(x):
                continue
            _, dist = _nearest(x, c, at)
            with np.errstate(divide="ignore"):
                keys = rng.exponential(size=dist.shape) / dist
            for s in range(len(at) - 1):
                few = np.argsort(keys[:, s])[:take]
                k, v = np.concatenate([best[s][0], keys[few, s]]), np.concatenate([best[s][1], x[few]])
                order = np.argsort(k)[:take]
                best[s] = k[order], v[order]
        for s, (k, v) in enumerate(best):
            ok = np.isfinite(k)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), s)), pa.array(k[ok]), pa.array(list(v[ok]), pa.list_(pa.float64()))],
                                                 names=["start", "key", "v"])

    got = vectors.mapInArrow(run, "start long, key double, v array<double>")
    by = Window.partitionBy("start").orderBy("key")
    found: list[list] = [[] for _ in chosen]
    for r in got.withColumn("at", F.row_number().over(by)).where(F.col("at") <= take).orderBy("start", "key").collect():
        found[r["start"]].append(r["v"])
    return [np.concatenate([c, np.array(f)]) if f else c for c, f in zip(chosen, found)]


def _seed_from(points: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ and a few moves over the weighted candidates of one start."""
    first = rng.choice(len(points), p=weights / weights.sum())
    centers = [points[first]]
    while len(centers) < k:
        d = np.min([((points - c) ** 2).sum(1) for c in centers], 0) * weights
        if d.sum() <= 0:
            break  # fewer different rows than centres
        centers.append(points[rng.choice(len(points), p=d / d.sum())])
    centers = np.array(centers)
    for _ in range(30):
        near, _ = _nearest(points, centers, [0, len(centers)])
        moved = np.array([np.average(points[near[:, 0] == j], axis=0, weights=weights[near[:, 0] == j])
                          if weights[near[:, 0] == j].sum() > 0 else centers[j] for j in range(len(centers))])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def _seeds(vectors: DataFrame, ks: list[int], n_init: int, seed: int, rounds: int, tasks: int) -> tuple[dict[tuple[int, int], np.ndarray], float]:
    """Starting centres of every (k, start): k-means|| candidates of each start, shared by all k; and the mean variance of the components."""
    spread = vector_to_array(Summarizer.variance(array_to_vector("v"))).alias("spread")
    first = vectors.groupBy(F.lit("all")).agg(*[F.min_by("v", F.xxhash64(F.lit(seed + s), "v")).alias(f"s{s}") for s in range(n_init)], spread).first()
    if first is None:
        return {}, 0.0
    chosen = [np.array([first[f"s{s}"]]) for s in range(n_init)]
    for step in range(rounds):
        chosen = _farther(vectors, chosen, 2 * max(ks), seed, step)
    chosen = [np.unique(c, axis=0) for c in chosen]
    cuts = np.cumsum([0, *map(len, chosen)]).tolist()
    weights, _, _ = _move(vectors, np.concatenate(chosen), cuts, tasks)
    return {(k, s): _seed_from(chosen[s], weights[cuts[s]:cuts[s + 1]], k, np.random.default_rng([seed, k, s]))
            for k in ks for s in range(n_init)}, float(np.mean(first["spread"]))


def fit_starts(df: DataFrame, ks: list[int], n_init: int = 10, seed: int = 42, features: str = "features", max_iter: int = 300,
               tol: float = 1e-4, seed_rounds: int = 2) -> dict[int, Clusters]:
    """The start of least inertia for every k, ties to the lower start.

    Rows without features, or with a null, NaN or infinite component, take no part.  Centres of fewer than k appear where there are fewer different
    rows.  A model ends when its centres' squared moves add up to no more than ``tol`` times the mean variance of the components (the
    reference's rule), or after ``max_iter`` passes; its inertia belongs to the centres returned.  Every pass is one aggregate whatever the number of models."""
    v = df.select(_array(df, features).alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    v = v.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = v.rdd.getNumPartitions()
        at, spread = _seeds(v, ks, n_init, seed, seed_rounds, tasks)
        done: dict[tuple[int, int], Clusters] = {}
        live = sorted(at)
        for step in range(max_iter):
            if not live:
                break
            cuts = np.cumsum([0, *[len(at[m]) for m in live]]).tolist()
            n, sums, cost = _move(v, np.concatenate([at[m] for m in live]), cuts, tasks)
            still = []
            for j, m in enumerate(live):
                count, total = n[cuts[j]:cuts[j + 1], None], sums[cuts[j]:cuts[j + 1]]
                moved = np.where(count > 0, total / np.maximum(count, 1), at[m])  # a centre without rows stays
                if step + 1 < max_iter and ((moved - at[m]) ** 2).sum() > tol * spread:
                    at[m] = moved
                    still.append(m)
                else:
                    done[m] = Clusters(at[m], float(cost[j]), m[1])
            live = still
    finally:
        v.unpersist()
    return {k: min((c for (kk, _), c in done.items() if kk == k), key=lambda c: (c.inertia, c.start)) for k in ks if (k, 0) in done}
