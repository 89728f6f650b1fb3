import hashlib
import math
import random
import re
import zlib
from collections import Counter

import edge
import numpy as np
import pytest

from sparkeda.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, order=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]


def buckets(text, order=2, size=10_000):
    return [zlib.crc32(g.encode()) % size for g in grams(text, order)[1]]


def brute(docs, target, percent=25, order=2, size=10_000):
    s, t = (Counter(b for x in texts for b in buckets(x, order, size)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + size) / ((s[b] + 1) * (n_t + size)))) for b in range(size)]
    rows = []
    for i, x in docs:
        f = buckets(x, order, size)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), grams(x)[0] >= 20))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(enough) * percent // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(enough)), key=str) + sorted(
        ((*r[:4], None) for r in rows if not r[4]), key=str)


def same(got, want):
    return sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("order,size", [(1, 10_000), (2, 10_000), (3, 100_000)])
def test_buckets(order, size, monkeypatch):
    rng = random.Random(order)
    texts = [None, "", " ... ", "One", "A b", "été 漢字 x-y_z 12", "x" * 3000 + " y " + "é" * 700, edge.text(400)]
    texts += ["".join(rng.choice("abAB \n.é漢0") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    f = resampling.Features(order, size)
    want = [(grams(t)[0], sorted(buckets(t, order, size))) for t in texts]
    assert [(n, sorted(np.frombuffer(x, f.kind).tolist())) for n, x in zip(*f.of(texts))] == want
    for piece in (1, 7, 50):  # texts longer than a piece are cut, with the same features
        monkeypatch.setattr(resampling, "PIECE", piece)
        assert [(n, sorted(np.frombuffer(x, f.kind).tolist())) for n, x in zip(*f.of(texts))] == want


def test_shifts_cancel_prefixes():
    rng = random.Random(5)
    a = [rng.randbytes(rng.randint(0, 90)) for _ in range(200)]
    b = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 1000, 70_000])) for _ in range(200)]
    whole = np.array([zlib.crc32(x + y) for x, y in zip(a, b)], np.uint32)
    first = np.array([zlib.crc32(x) for x in a], np.uint32)
    assert (whole ^ resampling.shifted(first, np.array([len(y) for y in b]))).tolist() == [zlib.crc32(y) for y in b]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(k, edge.text(rng.choice([5, 19, 20, 60, 200]), k % 40)) for k in range(150)]
    docs += [(1000, docs[3][1])] * 7 + [(None, edge.text(30, 4)), (None, None), (7, None), (8, "")]
    target = [edge.text(50, k) for k in range(3)] + [None]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, bucket int")
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent in (25, 100, 0):
        assert same(resampling.resample(spark, df, aim, percent=percent).collect(), brute(docs, target, percent))


def test_edges(spark):
    df = edge.frame(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    none = spark.createDataFrame([], "item_id long, text string")
    assert same(resampling.resample(spark, df, none).collect(), brute(docs, []))
    assert resampling.resample(spark, edge.empty(spark), none).collect() == []


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    df, aim = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert same(resampling.resample(spark, df, aim).collect(), brute(docs, [r["text"] for r in aim.collect()]))
