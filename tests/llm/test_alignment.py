import hashlib
from collections import Counter

import edge
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from sparkeda.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "\n\n x", "it's  x", "<|endoftext|> a</s> <s>", "<unk> <0x41> <0x0A>", "é 漢字 🎉🎉", "\x00 \x1f b", "▁x ▁", "a▁b",
       "thethethe" * 40, "x" * 300, "1234567 89", "hello" * 30 + "wörld" * 20, "a  b c", "été über naïve", "Ġ Ċ a", "tab\tand\r\nfeed"]


def spans(tokens):
    out, at = [], 0
    for k, x in tokens:
        out.append((k, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}
    docs = []
    for x in texts:
        none = ([], [], [], [])
        if not x:
            docs.append(none)
            continue
        a = [(k, bytes(letter[c] for c in t.id_to_token(k))) for k in t.encode(" " + x, add_special_tokens=False).ids]
        b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(x)]
        if any(b"".join(y for _, y in s) != (" " + x).encode() for s in (a, b)):
            docs.append(none)
            continue
        a, b = spans(a), spans(b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([k for k, s, e in a if lo <= s and e <= hi], [k for k, s, e in b if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        found = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        docs.append((a, b, groups, found))
    total = Counter(p for d in docs for p in d[3])
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    return [(len(a), len(b), len(g), len(f), sum(total[p] == most[p[1]] for p in f), sum(total[p] for p in f),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "")
            for a, b, g, f in docs]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1 << 18, 20, 0])
def test_equals_brute_force(spark, frequent):
    texts = [*ODD, *(a + " " + b for a in ODD[:8] for b in ODD[8:]), edge.text(200), edge.text(200), edge.text(90, 3), None]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, row int, links string")
    got = alignment.align(spark, df.repartition(3), A, B, frequent=frequent).orderBy("doc_id")
    assert got.columns == ["doc_id", *NAMES]
    assert [tuple(r[c] for c in NAMES) for r in got.collect()] == brute(texts)


def test_edges(spark):
    df = edge.frame(spark)
    df = df.where("length(text) < 6000 OR text IS NULL")
    rows = df.collect()
    want = sorted(zip([-1 if r["doc_id"] is None else r["doc_id"] for r in rows], brute([r["text"] for r in rows])))
    got = alignment.align(spark, df, A, B, frequent=50).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r[c] for c in NAMES)) for r in got) == want
    assert alignment.align(spark, edge.empty(spark), A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(spark, nothing, A, B).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_small_and_large_batches_agree():
    al, texts = alignment.Aligner(A, B, 5), [*ODD[1:], edge.text(3000)]
    whole = al.align(texts)
    for k, t in enumerate(texts):
        one = al.align([t])
        assert all(one[c][0] == whole[c][k] for c in one)


def test_both_ways_to_a_give_the_library_ids():
    al, t = alignment.Aligner(A, B), Tokenizer.from_file(A)
    t.encode_special_tokens = True
    assert al.ranks is not None
    low = [chr(c) for c in range(0x250)]
    texts = [*ODD, *(f"{c}" for c in low), *(f"a{c}b {c}{c} 1{c}2{c}\n{c} 's{c}" for c in low), "".join(low), "漢字 " * 50, "a " * 150_000]
    assert [x.tolist() for x in al._encode_a(texts)] == [t.encode(" " + x, add_special_tokens=False).ids for x in texts]
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    assert [x.tolist() for x in al._encode_b(texts)] == sp.encode(texts)
