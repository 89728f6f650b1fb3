import re
from collections import defaultdict

import edge
import pytest

from sparkeda.llm import mixing


def reshared(sizes, ratio, weights, cap):
    """Targets by handing the excess round until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, free, target = ratio * sum(sizes.values()), set(names), {}
    while free:
        share = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > cap * sizes[s]}
        if not over:
            target.update({s: share * w[s] for s in free})
            break
        target.update({s: cap * sizes[s] for s in over})
        free -= over
    return target


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("ratio", [0.4, 1.5, 1.9, 2.5])
def test_targets(spark, ratio):
    sizes = {"a": 100, "b": 900, "c": 10, "d": 4000, "é": 55, "Z": 70, None: 300, "z0": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, ratio).collect()}
    want = reshared(sizes, ratio, (5, 2, 1), 2.0)
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(k, edge.text(1 + (k * 37) % 90, k), None if k % 11 == 0 else f"s{k % 5 if k % 3 else 0}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, fan_in=8).collect()
    again = mixing.mix(df.repartition(7), fan_in=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(r["id"] for r in got) == list(range(3000))
    sizes, largest, taken, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += n_words(t)
        largest[s] = max(largest[s], n_words(t))
    want = reshared(sizes, 1.5, (5, 2, 1), 2.0)
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert r["size"] == n_words(text[r["id"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        share = want[r["source"]] / sizes[r["source"]]
        assert int(share) <= r["copies"] <= int(share) + 1
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(want)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_expectation_is_kept(spark):
    """Over many seeds a document is taken as often as its share says."""
    df = spark.createDataFrame([(k, edge.text(3 + k % 7, k), "a" if k < 25 else "b") for k in range(40)], "doc_id long, text string, source string")
    count, share = defaultdict(int), {}
    for seed in range(60):
        for r in mixing.mix(df, ratio=0.9, seed=seed * 1000, fan_in=4).collect():
            count[r["id"]] += r["copies"]
            share[r["id"]] = r["target"] / r["source_size"]
        if seed == 4:
            break
    assert sum(count.values()) / 5 == pytest.approx(sum(share.values()), rel=0.12)


def test_edges(spark):
    df = edge.frame(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    assert sum(r["size"] for r in got if r["id"] == 5) == 30_000
    assert {r["rep"] for r in got if r["id"] == 2 and r["size"] == 80} == {1, 2}
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    copies, rows = defaultdict(int), defaultdict(int)
    for r in got:
        copies[r["id"], r["source"], r["size"]] += r["copies"]
    for r in mixed.collect():
        rows[r["doc_id"], r["source"], n_words(r["text"])] += 1
    assert dict(rows) == {k: v for k, v in copies.items() if v}
    assert mixing.mix(edge.empty(spark)).count() == 0 and mixing.apply_mix(edge.empty(spark)).count() == 0


def test_hot_group_is_spread_and_reruns_agree(spark):
    """A third of all rows are alike in id, source and size: some the same text, some not."""
    from pyspark.sql import functions as F

    rows = [(k, edge.text(5 + k % 20, k), f"s{k % 3}", k) for k in range(4000)]
    rows += [(None, "", "s1", 0)] * 5000 + [(None, f"w{k % 700} end", "s1", k % 2) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(6)
    got = mixing.mix(df).groupBy("id", "source", "size").agg(F.sum("copies").alias("n")).collect()
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    rows = mixed.collect()
    count = defaultdict(int)
    for r in rows:
        count[r["doc_id"], r["source"], n_words(r["text"])] += 1
    assert dict(count) == {(r["id"], r["source"], r["size"]): r["n"] for r in got if r["n"]}
    again = mixing.apply_mix(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    given, taken = defaultdict(int), defaultdict(int)
    for r in df.collect():
        given[tuple(r)] += 1
    for r in rows:
        taken[tuple(r)] += 1
    assert all(taken[k] <= 2 * given[k] for k in taken)


def test_many_alike_are_numbered_by_several_tasks(spark):
    df = spark.createDataFrame([(1, "a", 3, 10_000), (None, None, 0, 7), (2, "a", 5, 4096), (3, "a", 5, 4097)], "id long, source string, size long, n long")
    got = mixing._numbered(df, run=1000).select("id", "rep").collect()
    for i, n in ((1, 10_000), (None, 7), (2, 4096), (3, 4097)):
        assert sorted(r["rep"] for r in got if r["id"] == i) == list(range(1, n + 1))
