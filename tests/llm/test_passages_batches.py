"""What op6 does for many units or texts at once equals what it did one by one."""

import random

import numpy as np

from sparkeda.llm import passages as P


def test_units_of_a_run_travel_together(spark):
    """A run of texts gives a row per part of the keys, not one per unit; the units are all there."""
    texts = [" ".join(f"w{random.Random(k * 100 + i // 7).random()}" for i in range(300)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").coalesce(1)
    rows = P._band_rows(df, 4, 2, 3).collect()
    units = P.Units(texts)
    assert len(rows) <= 3 * P.STRETCHES and {r["task"] for r in rows} == {0, 1, 2}
    assert sum(len(r["key"]) for r in rows) == len(units.windows()) + 4 * len(units.paragraphs)


def test_joined_equals_join_spans():
    rng = random.Random(5)
    units = [(rng.randrange(3), rng.randrange(2), s := rng.randrange(60), s + rng.randrange(1, 9), k := rng.randrange(60), k + rng.randrange(1, 9))
             for _ in range(300)]
    got = list(zip(*(x.tolist() for x in P._joined(*(np.array(c) for c in zip(*units))))))
    for doc in range(3):
        for keeper in range(2):
            mine = [u[2:] for u in units if u[:2] == (doc, keeper)]
            joined = [g[2:] for g in got if g[:2] == (doc, keeper)]
            assert [x[:2] for x in joined] == P.join_spans(mine, None)
            assert P.join_spans(joined, 0.5) == P.join_spans(mine, 0.5)
    assert all(not len(x) for x in P._joined(*[np.zeros(0, np.int64)] * 6))


def test_near_windows_of_several_texts():
    """Those of one text at a time; places that a text does not have (of another row with its id) give none in the next text."""
    texts = ["a b c", " ".join(map(str, range(40))), None, " ".join(map(str, range(25))), " ".join(map(str, range(50)))]
    at = {1: [0, 5, 9, 20], 3: [0, 5, 6, 28], 4: [2, 30]}
    text, pos = (np.array(x) for x in zip(*[(t, p) for t, ps in at.items() for p in ps]))
    units = P.Units(texts)
    linked = np.zeros(len(pos) - 1, bool)
    linked[1] = True
    spans = units.near(text, pos, linked)
    got = {(t, s) for t, s in zip(units.texts(spans).tolist(), (spans[:, 0] - units.first[units.texts(spans)]).tolist())}
    want = set()
    for t, ps in at.items():
        open_ = {(p, d) for p in ps for d in (-4, -3, -2, -1, 1, 2, 3, 4)}
        if t == 1:
            open_ -= {(5, d) for d in (1, 2, 3, 4)} | {(9, d) for d in (-4, -3, -2, -1)}
        n = len(texts[t].split())
        want |= {(t, p + d) for p, d in open_ if 0 <= p + d <= n - P.WORDS and p + d not in ps}
    assert got == want
