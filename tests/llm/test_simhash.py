import random

import edge
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkeda.llm import simhash
from sparkeda.llm.components import connected_components


def plain_fingerprint(text, n=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words)] if 0 < len(words) < n else [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    part = {n: n for n in nodes}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_spark_hash_is_the_same(spark):
    t = "Ein Wort, noch eins"
    assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == xxhash.xxh64(t.encode(), seed=42).intdigest()


@pytest.mark.parametrize("segments", [1, 9, 32])
@pytest.mark.parametrize("distance", [2, 3])
def test_links_equal_brute_force(spark, segments, distance):
    rng = random.Random(segments * 10 + distance)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, segments).collect()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 760)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "u long, v long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(want[n] == c for n, c in got.items())
    assert {n for e in edges if e[0] != e[1] for n in e} == set(got)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):
        w = edge.text(rng.randint(0, 300), k).split()
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            c = list(w)
            if c:
                c[rng.randrange(len(c))] = "CHANGED"
            texts.append(" ".join(c))
    got = {r["id"]: r for r in simhash.near_duplicates(edge.docs(spark, texts)).collect()}
    fp = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r["fp"] % (1 << 64) for k, r in got.items()} == fp
    edges = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {k: r["component_id"] for k, r in got.items()} == components(fp, edges)


def test_edges(spark):
    df = edge.frame(spark)
    got = simhash.near_duplicates(df)
    assert got.count() == df.count()
    rows = got.collect()
    zero = {r["id"] for r in rows if r["fp"] == 0}
    assert zero == {3, 4, 6, None} and {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, x) for x in (1, 2, 3, 5, 7, 8, 9, 10, 11)] + [(True, 0)]
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0 and simhash.one_of_each(edge.empty(spark)).count() == 0


def test_very_long_text_in_blocks():
    t = edge.text(70_000, 8)
    h = np.array([xxhash.xxh64_intdigest(" ".join(w).encode(), 42) for w in zip(*[t.split()[k:] for k in range(3)])], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(t, 3) == want
