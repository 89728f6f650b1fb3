import re
from collections import Counter

import edge
import numpy as np

from sparkeda.llm import quality


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often, seen = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            seen.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(seen))


TEXTS = ["a b c d e a b c d e", "x x x x x x x", "a\n\na\n a\nb\t\n\n", "", None, "# $ <b>\x0bq\xa0r é漢", "p q r s t u p q r s t u v p q r s t",
         "Ünï code space", "w " * 30]


def test_counts_equal_brute_force():
    for t in [*TEXTS, *(r[1] for r in edge.rows())]:
        assert quality.text_stats(t)[:5] == plain(t)


def test_list_separates_held_out_rows():
    rng = np.random.default_rng(1)
    n, names = 4000, ["a", "b", "c"]
    x = rng.random((n, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)
    flip = rng.random(n) < 0.01
    rules = quality.learn_rules(x[:2000], bad[:2000] ^ flip[:2000], names)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= r.covers(x[2000:], names)
    assert (hit == bad[2000:]).mean() > 0.97 and len(rules) >= 2
    assert quality.learn_rules(x[:200], np.zeros(200, bool), names) == []


def test_held_out_accuracy_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    s = quality.with_stats(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), keep=["quality"])
    got = s.where(~quality._named(quality.BASE_FAILED)).select("quality", quality.verdict(rules).alias("kept")).collect()
    assert len(got) > 100 and np.mean([r["kept"] == (r["quality"] == 1) for r in got]) > 0.97


def test_verdict_equals_the_rules_in_plain_python(spark):
    """The conditional expression over all documents against each rule, condition by condition."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules

    def rejected(rule, values):
        env = {"greatest": max, **values}
        return all(eval(quality.FEATURES[f], env) > t if op == ">" else eval(quality.FEATURES[f], env) <= t for f, op, t in rule.conditions)

    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, by_rule = quality.judge(docs, labels).collect(), 0
    assert len(got) == len(text)
    for r in got:
        n = plain(text[r["id"]])
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        hit = any(rejected(x, r.asDict()) for x in rules)
        by_rule += hit and not failed
        assert tuple(r[s] for s in quality.STATS[:5]) == n and r["base_failed"] == failed and r["kept"] == (not failed and not hit)
    assert by_rule > 5


def test_edges(spark):
    df = edge.frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (8, None), (77, 0)], "doc_id long, quality int")
    got = quality.judge(df, labels)
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # one class only: an empty list
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(edge.empty(spark), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == kept.count()
