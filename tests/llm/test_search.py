import math
import random

import pytest

from sparkeda.llm import search

KINDS = "vec_id long, embedding array<float>, query_id long, v int, pair int"


def brute(rows, queries, k, scale=256.0):
    good, every = {}, []
    for i, v, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and all(
            c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0], [math.floor(scale * c) for c in r[1]])):
        every.append((i, [math.floor(scale * c) for c in v]))
        good.setdefault(*every[-1])
    out = {}
    for q in queries:
        if q in good:
            s = sorted(((-sum(a * b for a, b in zip(good[q], x)), i) for i, x in every if i != q))[:k]
            out[q] = [(i, -s_) for s_, i in s]
    return out


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], KINDS)
    got = {}
    for r in search.search(df, df.where(df.vec_id.isin(list(queries))), **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("seed,sparse", [(1, 0.0), (2, 0.8), (3, 0.97), (4, 0.5)])
def test_equal_brute_force(spark, seed, sparse):
    rng = random.Random(seed)
    rows = [(k, [0.0 if rng.random() < sparse else round(rng.gauss(0, 0.1), 2) for _ in range(12)]) for k in range(400)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(200)]  # one common vector, many ties
    queries = [0, 1, 2, 50, 399, 1001]
    for kw in ({}, {"shard_rows": 60, "query_rows": 2}):
        assert run(spark, rows, queries, k=5, **kw) == brute(rows, queries, 5)


def test_low_scores_and_few_rows(spark):
    rows = [(k, [-1.0 - k, -2.0]) for k in range(8)] + [(20, [1.0, 1.0]), (21, [0.0, 0.0]), (22, [])]
    assert run(spark, rows, [20, 21, 22, 0], k=5) == brute(rows, [20, 21, 22, 0], 5)
    assert run(spark, rows[:1], [0], k=5) == {}
    many = [(k, [-1.0, -0.5 * (k % 7)]) for k in range(300)] + [(500, [0.0, 0.0]), (501, [2.0, 1.0])]
    assert run(spark, many, [501], k=3, shard_rows=1000) == brute(many, [501], 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
            (5, [0.5, 2.0]), (6, [1.0]), (7, [3.0, 1.0, 5.0]), (8, [])]
    assert run(spark, rows, [1, 2, 5, 6, 7, 8], k=5) == brute(rows, [1, 2, 5, 6, 7, 8], 5)
    big = [(k, [3e10 * (k + 1), 1.0]) for k in range(4)]
    got = run(spark, big, [0], k=2)
    assert [i for i, _ in got[0]] == [1, 2] or got[0][0][1] == (1 << 63) - 1
    e = spark.createDataFrame([], KINDS)
    assert search.search(e, e).count() == 0


def test_each_row_of_an_id_is_a_candidate(spark):
    rows = [(1, [1.0, 1.0]), (1, [3.0, 3.0]), (1, [3.0, 3.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])]
    for kw in ({}, {"shard_rows": 2}):
        assert run(spark, rows, [2], k=4, **kw) == {2: [(1, 256 * 768), (1, 256 * 768), (3, 256 * 512), (1, 256 * 256)]}


def test_tasks_are_bounded(spark, monkeypatch):
    """However many pairs of shards and blocks there are, so many tasks share them."""
    monkeypatch.setattr(search, "TASKS", 3)
    rows = [(k, [k % 7 / 8, k % 5 / 8]) for k in range(60)]
    assert run(spark, rows, range(0, 60, 3), k=4, shard_rows=7, query_rows=2) == brute(rows, range(0, 60, 3), 4)
