import random

import edge
import pytest
from pyspark.sql import functions as F

from sparkeda.llm import passages as P


def found(spark, texts, **kw):
    return P.repeated_passages(edge.docs(spark, texts), **kw).collect()


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(1)
    planted = [edge.text(51 + 3 * k, 1000 + k) for k in range(12)]
    texts, where = [], {}
    for k in range(120):
        w = edge.text(rng.randint(60, 400), k).split()
        if k % 3 == 0:
            p = planted[k // 3 % 12].split()
            at = rng.randrange(len(w))
            w = w[:at] + (p if k % 2 else [x.upper() for x in p]) + w[at:]
            where[k] = (at, at + len(p))
        texts.append(" ".join(w).replace(" ", "\n", k % 5))
    rows = found(spark, texts)
    assert {r["doc_id"] for r in rows} == set(where)
    for r in rows:
        lo, hi = where[r["doc_id"]]
        assert lo <= r["start_word"] and r["end_word"] <= hi
        assert r["keeper_id"] // 3 % 12 == r["doc_id"] // 3 % 12 and r["removed"] == (r["doc_id"] != r["keeper_id"])
    for d in where:  # all documents of a passage have a paragraph in common with the first
        first = min(x for x in where if x // 3 % 12 == d // 3 % 12)
        assert any(r["doc_id"] == d and r["keeper_id"] == first for r in rows)


def test_similar_paragraphs_join(spark):
    """Paragraphs that agree but for their last word are similar, those that differ in the middle are not."""
    base = edge.text(P.WORDS, 3).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:9], "other", *base[10:]]), " ".join(["other", *base[1:]])]
    rows = {r["doc_id"]: r for r in found(spark, texts, recall=0.999999)}
    assert set(rows) == {0, 1, 3} and {r["keeper_id"] for r in rows.values()} == {0}


def test_bands():
    assert P.tune_bands(0.8, 0.98, 2) == 4
    for s, recall, rows in ((0.8, 0.99, 2), (0.8, 0.95, 3), (0.5, 0.9, 1)):
        b = P.tune_bands(s, recall, rows)
        assert 1 - (1 - s ** rows) ** b >= recall > 1 - (1 - s ** rows) ** (b - 1)


def test_blocks_find_all_similar(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    base = edge.text(P.WORDS, 3).split()
    texts = [" ".join([*base[:-1], f"end{k}"]) for k in range(60)]
    rows = found(spark, texts, recall=0.999999)
    assert len({r["doc_id"] for r in rows}) == 60 and {r["keeper_id"] for r in rows} == {0}


@pytest.mark.parametrize("copies", [2, 700])
def test_groups_of_copies(spark, copies):
    rows = found(spark, [edge.text(200, 1)] * copies + [edge.text(200, 2), edge.text(9, 3), edge.text(9, 3), "a b"])
    assert {r["doc_id"] for r in rows} == set(range(copies)) | {copies + 1, copies + 2}
    assert all(r["keeper_id"] in (0, copies + 1) for r in rows)


def test_cut(spark):
    df = edge.docs(spark, [edge.text(80, 1) + " tail", " x " + edge.text(80, 1) + "\nend here"])
    out = [r["text"] for r in P.cut_passages(df, P.repeated_passages(df)).orderBy("doc_id").collect()]
    assert out[0] == edge.text(80, 1) + " tail"
    left = out[1].split()
    assert left[0] == "x" and left[-1] == "here" and len(left) < 50


def test_edges(spark):
    df = edge.frame(spark)
    rows = P.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == {1, 2} and {r["keeper_id"] for r in rows} == {1}
    assert P.repeated_passages(edge.empty(spark)).count() == 0
    assert P.cut_passages(df, P.repeated_passages(df)).columns == df.columns
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert P.repeated_passages(none).count() == 0


def _planted(n, passage, seed, other=None):
    """Two texts of random words around a passage and its copy (or ``other``), and where it begins in them."""
    rng = random.Random(seed)
    parts = [[f"w{rng.randrange(10**9)}" for _ in range(rng.randint(30, 90))] for _ in range(4)]
    return ([" ".join([*parts[0], *passage, *parts[1]]), " ".join([*parts[2], *(other or passage), *parts[3]])], len(parts[0]), len(parts[2]))


def test_exact_passages_are_found_to_their_ends(spark):
    """Of 24 words or more, wherever they stand: every one, and all of its words."""
    texts, want = [], set()
    for k in range(120):
        n = (24, 30, 40, 51, 100)[k % 5]
        pair, a, b = _planted(n, [f"p{k}x{i}" for i in range(n)], k)
        want |= {(2 * k, a, a + n, 2 * k), (2 * k + 1, b, b + n, 2 * k)}
        texts += pair
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["keeper_id"]) for r in found(spark, texts)} == want


def test_similar_passages_against_brute_force(spark):
    """Passages of 26 to 150 words, edited at random: whenever Jaccard similarity is 0.8 or more, one is found,
    and with one changed word in 60 the span goes over it."""
    texts, near, rng = [], [], random.Random(4)
    for k in range(150):
        n = rng.randint(26, 150)
        p = [f"p{k}x{i}" for i in range(n)]
        q = list(p)
        for _ in range(rng.randint(1, 1 + n // 45)):
            at = rng.randrange(len(q))
            q[at:at + rng.randint(0, 1)] = [f"new{rng.randrange(10**9)}"][:rng.randint(0, 1)]
        a, b = ({tuple(x[i:i + P.SHINGLE]) for i in range(len(x) - P.SHINGLE + 1)} for x in (p, q))
        if p != q and len(a & b) >= 0.8 * len(a | b):
            near.append(2 * k + 1)
        texts += _planted(n, p, k, q)[0]
    p = [f"q{i}" for i in range(60)]
    pair, a, b = _planted(60, p, 999, [*p[:30], "changed", *p[31:]])
    rows = found(spark, texts + pair)
    assert len(near) > 60 and set(near) <= {r["doc_id"] for r in rows}
    assert [(r["start_word"], r["end_word"]) for r in rows if r["doc_id"] == 301] == [(b, b + 60)]


def test_lines_and_blocks_are_units(spark):
    """A line of 12 words and a block of 16, of which the last is changed, between others."""
    line, block = edge.text(12, 50), edge.text(16, 51).split()
    mine = ["{}\n" + line + "\n{}\n\n" + " ".join(block[:8]) + "\n" + " ".join([*block[8:-1], end]) + "\n\n{}" for end in (block[-1], "other")]
    texts = [m.format(*[" ".join(f"f{k}x{j}x{i}" for i in range(20)) for j in range(3)]) for k, m in enumerate(mine)]
    rows = found(spark, texts, recall=0.999999)
    for d in (0, 1):
        assert {(r["start_word"], r["end_word"]) for r in rows if r["doc_id"] == d} == {(20, 32), (52, 67)}


def _grams(texts, n=P.WORDS):
    """Where each run of n words stands: text numbers."""
    out = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            out.setdefault(tuple(w[i:i + n]), set()).add(k)
    return out


def _kept_windows(spark, texts):
    """The repeated windows that lie in a shared run of ``WORDS + SPREAD - 1`` words, and those of them that the cut texts lack."""
    df = edge.docs(spark, texts)
    cut = [r["text"] for r in P.cut_passages(df, P.repeated_passages(df)).orderBy("doc_id").collect()]
    long = [g for g, d in _grams(texts, P.WORDS + P.SPREAD - 1).items() if len(d) > 1]
    wanted = {g[i:i + P.WORDS] for g in long for i in range(P.SPREAD)}
    return wanted, wanted - set(_grams(cut)), cut


def test_a_keeper_keeps_what_it_keeps(spark):
    """A line, the line with a changed word, and that one inside another text."""
    line = edge.text(60, 7).split()
    other = [*line[:10], "changed", *line[11:]]
    inside = " ".join([*(f"a{k}" for k in range(50)), *other, *(f"b{k}" for k in range(50))])
    wanted, lost, cut = _kept_windows(spark, [" ".join(line), " ".join(other), inside])
    assert len(wanted) >= 41 and not lost and any("changed" in t for t in cut) and len(cut[2].split()) < 110


@pytest.mark.parametrize("seed", [1, 2])
def test_no_repeated_window_is_lost(spark, seed):
    """Texts put together from a few passages, whole, cut or changed, in any order, some of them copies: whatever long run stood in two texts,
    all of its windows still stand in some text, though the texts have become much shorter."""
    rng = random.Random(seed)
    stock = [edge.text(rng.randint(25, 120), 300 + k).split() for k in range(8)]
    texts = []
    for k in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = list(rng.choice(stock))
            a = rng.randrange(len(p) // 2) if rng.random() < 0.5 else 0
            p = p[a:rng.randint(a + 10, len(p))]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = f"x{rng.randrange(10**6)}"
            parts.append(" ".join([*p, *(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([0, 0, 7, 40])))]))
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    texts += texts[:15]
    wanted, lost, cut = _kept_windows(spark, texts)
    assert len(wanted) > 300 and not lost
    assert sum(len(t.split()) for t in cut) < 0.7 * sum(len(t.split()) for t in texts)


def test_recall_of_short_lines(spark):
    """Lines and blocks of 12 to 24 words that are similar at 0.8 or more, each in a text of its own: found as registered."""
    rng, texts, near = random.Random(12), [], []
    for k in range(400):
        n = rng.randint(12, 24)
        p = [f"p{k}x{i}" for i in range(n)]
        q = list(p)
        at = rng.choice([0, n - 1, 1, n - 2])
        q[at] = f"new{k}"
        a, b = ({tuple(x[i:i + P.SHINGLE]) for i in range(len(x) - P.SHINGLE + 1)} for x in (p, q))
        if len(a & b) >= 0.8 * len(a | b):
            near.append(2 * k + 1)
        half = n // 2
        for x in (p, q):
            lines = [" ".join(x)] if k % 2 else [" ".join(x[:half]), " ".join(x[half:])]
            own = [" ".join(f"f{len(texts)}x{j}x{i}" for i in range(15)) for j in range(2)]
            texts.append(own[0] + "\n\n" + "\n".join(lines) + "\n\n" + own[1])
    hit = {r["doc_id"] for r in found(spark, texts)}
    assert len(near) > 150 and len(hit & set(near)) >= 0.95 * len(near)


def test_scratch_tables_go(spark):
    """Only the result's table is left."""
    import os

    from sparkeda.llm.common import shared_dir
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = [edge.text(80, 1), edge.text(80, 1) + " more", edge.text(40, 2)]
    assert found(spark, texts)
    left = {f.split("-")[1] + "-" + f.split("-")[2] for f in set(os.listdir(folder)) - before if f.startswith("llm-")}
    assert left == {"passages-spans"}
