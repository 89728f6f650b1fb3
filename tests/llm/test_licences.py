import random
import re

import edge

from sparkeda.llm import licences as L


ROWS = [(k, t, set(L.bigrams(L.normal_words(t)))) for k, many in L.TEMPLATES.items() for t in many]


def dice(words, grams):
    g = set(L.bigrams(words))
    return 2 * len(g & grams) / (len(g) + len(grams)) if g else 0


def brute(text, threshold=L.THRESHOLD):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    lines, blocks = low.split("\n"), re.split(r"\n[ \t\r]*\n", low)
    units = [("line", k, x) for k, x in enumerate(lines)] + [("block", k, x) for k, x in enumerate(blocks) if "\n" in x]
    units += [("text", 0, low)] if len(blocks) > 1 else []
    out = {}
    for unit, no, body in units:
        w = L.normal_words(body)
        for name, _, grams in ROWS:
            if (d := dice(w, grams)) >= threshold:
                out[unit, no, len(w), name] = max(d, out.get((unit, no, len(w), name), 0))
    for lo, hi, found in runs(L.normal_words(low), threshold):
        out |= {("passage", lo, hi - lo, name): d for name, d in found.items()}
    top = {}
    for (unit, no, *_), d in out.items():
        top[unit, no] = max(d, top.get((unit, no), 0))
    return {k: (d, d == top[k[:2]]) for k, d in out.items()}


def runs(w, threshold):
    """Runs of windows that reach the threshold: every anchor at every place that its template has it."""
    windows = set()
    for gram, number, place in L.anchor_bigrams():
        name, text, grams = ROWS[number]
        for i in range(len(w) - 1):
            if f"{w[i]} {w[i + 1]}" == gram:
                lo, hi = max(0, i - place), min(len(w), i - place + len(L.normal_words(text)))
                if (d := dice(w[lo:hi], grams)) >= threshold:
                    windows.add((lo, hi, name, d))
    out = []
    for lo, hi, name, d in sorted(windows):
        if not out or lo >= out[-1][1]:
            out.append((lo, hi, {}))
        start, end, found = out[-1]
        out[-1] = (start, max(end, hi), found | {name: max(d, found.get(name, 0))})
    return out


def test_equal_brute_force(spark):
    rng, texts = random.Random(1), []
    for name, many in L.TEMPLATES.items():
        for t in many:
            w = t.split()
            texts.append(t)
            texts.append(f"{edge.text(20)}\n{t.upper()}\n{edge.text(9)}")
            for n in (1, 2, 4):
                c = list(w)
                for _ in range(n):
                    c[rng.randrange(len(c))] = "other"
                texts.append(" ".join(c))
                texts.append("\n".join([" ".join(c[:len(c) // 2]), " ".join(c[len(c) // 2:]), "", "tail"]))
            texts.append(" ".join(w[:len(w) * 3 // 4]))
            texts.append(f"{edge.text(15, 3)} {t} {edge.text(12, 4)} {t.replace(' ', ' , ')}. {t}")
    texts += ["\n\n".join(L.TEMPLATES["MIT"][2:5]), "", " ", "mit", "Licensed", None, "license " * 50, "...\n. .\n"]
    got = {}
    for r in L.scan(edge.docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["unit"], r["unit_no"], r["n_words"], r["licence"]] = (r["dice"], r["best"])
    want = {k: b for k, b in ((k, brute(t)) for k, t in enumerate(texts)) if b}
    assert got == want and len(want) > 60


def test_anchors_lose_nothing():
    anchors = {}
    for g, number, _ in L.anchor_bigrams():
        anchors.setdefault(number, set()).add(g)
    pattern = re.compile(L.bigram_pattern([g for some in anchors.values() for g in some]))
    for number, (_, text, grams) in enumerate(ROWS):
        assert len(grams - anchors[number]) < L.THRESHOLD / (2 - L.THRESHOLD) * len(grams)  # what is left can't reach the threshold
        for g in anchors[number]:
            a, b = g.split()
            assert all(pattern.search(x) for x in (g, f"..{a}.\n# ..{b}.", f"x {a} / {b}")) and not pattern.search(f"x{a} {b}")


def test_licences_wherever_they_stand(spark):
    """Whole licences on one line, in comments, wrapped anew, and notices inside longer lines; prose has none."""
    mit, bsd = " ".join(L.TEMPLATES["MIT"][2:5]), L.TEMPLATES["BSD-3-Clause"][2]
    words = bsd.split()
    wrapped = "\n".join(" * " + " ".join(words[k:k + 11]) for k in range(0, len(words), 11))
    texts = [mit, "Copyright (c) 2020 Someone " + mit + " " + edge.text(300, 6), "/*\n" + wrapped + "\n */\nint main() {}",
             edge.text(40, 7) + " Released under the MIT License. " + edge.text(40, 8), "# SPDX-License-Identifier: GPL-2.0-or-later\nimport os",
             "\n".join("// " + x for x in L.TEMPLATES["GPL-3.0"][1].split(", ")), edge.text(2000, 9), "free software source code without any licence " * 9]
    got = {}
    for r in L.scan(edge.docs(spark, texts)).where("unit = 'passage' AND best").collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    assert got == {0: {"MIT"}, 1: {"MIT"}, 2: {"BSD-3-Clause"}, 3: {"MIT"}, 4: {"GPL-2.0"}, 5: {"GPL-3.0"}}


def test_many_notices_in_one_text(spark):
    text = "\n".join(f"{edge.text(3, k)} Licensed under the MIT License." for k in range(2000))
    r = L.scan(edge.docs(spark, [text])).where("unit = 'passage'").collect()
    assert len(r) == 2000 and all(x["dice"] == 1 and x["n_words"] == 5 and x["unit_no"] == 8 * k + 3 for k, x in enumerate(sorted(r, key=lambda x: x["unit_no"])))


def test_edges(spark):
    df = edge.frame(spark)
    assert L.scan(df).count() == 0 and L.scan(edge.empty(spark)).count() == 0
    twice = edge.docs(spark, ["Released under the MIT License."]).unionByName(edge.docs(spark, ["Released under the MIT License."]))
    assert L.scan(twice).count() == 4
    plan = L.scan(df)._jdf.queryExecution()
    assert "Python" not in plan.toString() and "Exchange" not in plan.toString()
    assert "from_json" not in plan.optimizedPlan().toString()  # templates and anchors are constants
