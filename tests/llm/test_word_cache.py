"""Known words are looked up once, new ones are learned once, and a full cache keeps the words at hand."""

from sparkeda.llm.common import WordCache
from sparkeda.llm.queries import tokenizer_path
from sparkeda.llm.tokenfiles import Encoder


class Counting(dict):
    lookups = 0

    def get(self, *key):
        Counting.lookups += 1
        return super().get(*key)


def test_lookups_and_eviction():
    asked = []
    cache = WordCache(4, lambda ws: asked.append(ws) or [w.upper().encode() for w in ws])
    assert cache.texts([["a", "b", "a"], [], ["c"]]) == [b"ABA", b"", b"C"] and asked == [["a", "b", "c"]]
    cache.known = Counting(cache.known)
    assert cache.texts([["a", "a", "c"]]) == [b"AAC"] and Counting.lookups == 3
    assert cache.texts([["c", "d", "e"], ["c"]]) == [b"CDE", b"C"] and cache.known.keys() == {"c", "d", "e"}


def test_fresh_words_are_one_call():
    """Plain words that no worker has met go to the library together, with the ids of whole texts."""
    e, calls = Encoder(tokenizer_path("byte_bpe_50k.json")), []
    bare = e.bare
    e.bare = type("Bare", (), {"encode_batch_fast": lambda self, x, **k: calls.append(1) or bare.encode_batch_fast(x, **k)})()
    text = " ".join(f"w{c}{d}ü{c}é, {d}{c}straße" for c in "abcdefghijkl" for d in "mnopqrstuvwxyz") + "\nend.\nof İt ŉ ẞ Ω"
    assert e.encode([text, text]) == e._whole([text, text]) and len(calls) == 1


def test_different_words_are_looked_up_once():
    """However often a word stands in the texts encoded together, the encoder asks the cache once."""
    e = Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["one two one\ntwo one, one"] * 50 + ["two one", "naïve  one", ""]
    e.encode(texts)
    e.words.known, Counting.lookups = Counting(e.words.known), 0
    assert e.encode(texts) == e._whole(texts) and Counting.lookups == 5
