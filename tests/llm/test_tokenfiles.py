import glob
import zlib

import edge
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sparkeda.llm import tokenfiles
from sparkeda.llm.common import new_path, spaced_words

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a b ", " a", "\n\n x", "a\n b", "a\u00a0 b", "a \u2003b", "it's we'll  x", "1 2 3", "<|endoftext|> a", "a <|endoftext|>", "a<|endoftext|>b <|endof", "é 漢字 🎉", "\x00 \x1f b",
       "a \x1cb", "a \x85 b", "a \u200b b", "...  !!", "\t a\tb"]


def direct(texts, special_as_text=False):
    """The library as it comes, or with the strings of special tokens as ordinary text."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = special_as_text
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_library_ids():
    texts = [*ODD, *(a + " " + b for a in ODD for b in ODD), edge.text(500), "ther, ther. ther Ther.\nther, ther., été! über; naïve: x1. x_. a'. it's. ʼn. ǆ, 漢. a..b, ...\nFin."]
    for size in (tokenfiles.CACHE_SIZE, 3):
        for plain in (False, True):
            enc = tokenfiles.Encoder(PATH, size, plain)
            for _ in range(2):
                assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == direct(texts, plain)


def test_special_tokens_are_the_library_s():
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfiles.Encoder(PATH).encode(["<|endoftext|> hi"])] == [[50256, 23105]]


def test_files(spark):
    df = edge.frame(spark)
    path = new_path(spark, "test")
    tokenfiles.write_token_files(df, path, PATH, end_id=2, page_rows=3, partitions=3)
    got = tokenfiles.read_token_files(spark, path)
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfiles.with_crc32(got).collect()}
    rows = sorted(got.collect(), key=lambda r: r["start"])
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    ids = {k: sorted(x + [2] for x in direct(v)) for k, v in texts.items()}
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == sorted((k is not None, k or 0) for k, v in texts.items() for _ in v)
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["tokens"]) and r["tokens"] in ids[r["doc_id"]]
        assert crc[r["doc_id"], start] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())
        start += r["n_tokens"]
    assert "tokens" not in tokenfiles.read_token_files(spark, path, tokens=False).columns
    kinds, paged = set(), 0
    for f in glob.glob(f"{path}/*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                col = m.row_group(g).column(c)
                kinds.update((col.path_in_schema.split(".")[0], e) for e in col.encodings)
                paged += col.has_column_index
    assert ("tokens", "RLE_DICTIONARY") in kinds and ("n_tokens", "DELTA_BINARY_PACKED") in kinds and paged
    plan = tokenfiles.read_token_files(spark, path, tokens=False).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,3)" in plan


def test_empty(spark):
    path = new_path(spark, "test")
    tokenfiles.write_token_files(edge.empty(spark), path, PATH)
    assert tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path)).count() == 0


@pytest.mark.parametrize("text,want", [("a b", ["\na", "b"]), ("a\nb c", ["\na", "\nb", "c"]), ("a  b", None), ("", None), (" a", None),
                                       ("a b ", None), ("a\tb", None), ("a \x85b", None), ("a  b\tc", None), ("x \ta", None)])
def test_cuts(text, want):
    assert spaced_words(text) == want
