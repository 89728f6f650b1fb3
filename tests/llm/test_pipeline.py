"""run() against the same stages in plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import edge
import public_tokenizers
import sentencepiece
from test_quality import plain
from test_simhash import components, plain_fingerprint

from sparkeda.llm import quality, surrogates
from sparkeda.llm.queries import PII_KEY

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "encode_pieces"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    rules = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(t):
        n = plain(t)
        values = dict(zip(quality.STATS, quality.text_stats(t)))
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            return False
        env = {"greatest": max, **values}
        return not any(all(eval(quality.FEATURES[f], env) > x if op == ">" else eval(quality.FEATURES[f], env) <= x
                           for f, op, x in r.conditions) for r in rules)

    kept = {i for i, r in docs.items() if good(r["text"])}
    fp = {i: plain_fingerprint(docs[i]["text"]) for i in kept}
    comp = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    kept = {i for i in kept if comp[i] == i}
    now = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), table.schema)
    assert {r["doc_id"] for r in now.collect()} == kept and now.columns == table.columns
    text = {r["doc_id"]: r["text"] for r in now.collect()}
    for i in kept:
        old, new = docs[i]["text"], text[i]
        spans = surrogates.detect(old)
        assert (old == new) == (not spans)
        assert not any(k != "ip" and old[s:e] in new for s, e, k in spans)
    assert PII_KEY
    got = corpus_pipeline.run(spark, SF).collect()
    count = Counter(r["doc_id"] for r in got)
    size, total, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in kept:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text[i]))
        total[docs[i]["source"]] += size[i]
        taken[docs[i]["source"]] += size[i] * count[i]
    assert max(count.values()) <= 2 and set(count) <= kept
    assert sum(taken.values()) <= 2 * sum(total.values())
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= sum(max(size[i] for i in kept if docs[i]["source"] == s) for s in total)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["token_ids"] == sp.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names and no rows, stage by stage."""
    odd, none = edge.frame(spark), edge.empty(spark)
    whole = Counter(r["text"] for r in odd.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        got, nothing = stage(spark, odd, SF), stage(spark, none, SF)
        rows = got.collect()
        assert nothing.count() == 0, name
        if last:
            assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and len(rows) == odd.count()
            continue
        assert got.columns == odd.columns == nothing.columns, name
        texts = Counter(r["text"] for r in rows)
        if name == "quality_rules":
            assert texts == Counter({t: n for t, n in whole.items() if len((t or "").split()) >= 10})
        elif name == "near_duplicates":
            fp = {t: plain_fingerprint(t) for t in whole}
            assert set(texts) <= set(whole) and all(any((fp[t] ^ fp[o]).bit_count() <= 2 for o in texts) for t in whole)
        elif name == "personal_data":
            assert texts == whole  # nothing in them is personal
        else:
            assert set(texts) <= set(whole) and all(n <= 2 * whole[t] for t, n in texts.items())


def test_personal_data_on_a_cluster_without_a_key(spark, monkeypatch):
    """The stage runs on a master that is not local, and digits of other scripts do not end it."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.delenv("PII_KEY", raising=False)
    texts = ["call 555-012-3456 now", "call ٥٥٥-٠١٢-٣٤٥٦ now", "nothing here"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in corpus_pipeline.personal_data(spark, docs, SF).orderBy("doc_id").collect()]
    assert got[2] == texts[2] and all(a != b and len(a) == len(b) for a, b in zip(got[:2], texts))
    assert got[0] == "".join(str(int(c)) if c.isdecimal() else c for c in got[1])
