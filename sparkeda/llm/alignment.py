"""Cross-tokenizer alignment (operator 11).

Tokenizer A is a byte-level file of the tokenizers library and reads a space and the text; tokenizer B is a
SentencePiece file and adds that space itself, so the tokens of both cover the same bytes.  Per batch of
documents, two ``pandas.merge_asof`` keyed by the document find the covering B token of each A start and the covering A token
of each B start; the union of both directions is every pair of tokens whose byte ranges overlap, since one
of the two starts lies in the other token.  Ends that both sides share cut a document into groups.

How often a pair of ids is linked in the corpus is counted from the written links; the counts come back to the
documents through a table of the most frequent pairs, whose size is set, and a join for all other pairs.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkeda.llm import pieces, tokenfiles
from sparkeda.llm.common import runs, written

#: Words whose ids a worker remembers for texts that A's library encodes; more are encoded again.
CACHE_SIZE = 100_000
#: Texts beyond this length, and those with characters whose classes Unicode versions disagree on, stay with the
#: tokenizers library; the ids are the same.
LONG_TEXT, RARE = 200_000, re.compile("[^\x00-\u024f]")
#: Pairs of ids that every worker holds with their counts (17 bytes each); the others are joined.
FREQUENT_PAIRS = 1 << 18
#: Characters that are aligned at a time.
BATCH_CHARS = 1 << 20
_WORKER: dict = {}


class Spelled:
    """Byte strings of ids, put together for arrays of ids at once."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's end."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Aligner:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str, cache_size: int = CACHE_SIZE):
        import sentencepiece

        self.a = tokenfiles.Encoder(path_a, cache_size, special_as_text=True)
        letter = {c: b for b, c in {**{b: chr(x) for b, x in enumerate(tokenfiles.BYTE_LETTERS)}, 10: chr(266)}.items()}
        added = {k: t.content.encode() for k, t in self.a.tok.get_added_tokens_decoder().items()}
        vocab = sorted((k, t) for t, k in self.a.tok.get_vocab(True).items())
        self.bytes_a = [b""] * (vocab[-1][0] + 1)
        for k, t in vocab:
            self.bytes_a[k] = added[k] if k in added else bytes(letter.get(c, ord(c) & 255) for c in t)
        self.ranks = self._ranks(path_a, added)
        m = pieces.Codec(path_b, 0).model
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [p.replace(pieces.SPACE, " ").encode() for p in m.pieces]
        for byte, k in m.bytes.items():
            self.bytes_b[k] = bytes([byte])
        self.spelled = Spelled(self.bytes_a), Spelled(self.bytes_b)
        # an id in a group's list with what follows it: "," inside the group, "|" or ";" after its last id
        self.listed = Spelled([str(k).encode() + e for x, last in ((self.bytes_a, b"|"), (self.bytes_b, b";"))
                               for k in range(len(x)) for e in (b",", last)])

    def _ranks(self, path: str, added: dict):
        """The same merges as ranks, which encode faster, where ids rise in the order of the merges."""
        if not self.a.by_word:
            return None
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if model.get("ignore_merges") or any(x >= y for x, y in zip([255, *made], made)) or len(made) + 256 != len(model["vocab"]):
            return None
        ranks = {x: k for k, x in enumerate(self.bytes_a) if k not in added}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode_a(self, texts: list[str]) -> list[np.ndarray]:
        fast = [self.ranks is not None and len(t) <= LONG_TEXT and (t.isascii() or not RARE.search(t)) for t in texts]
        rest = iter(self.a.encode([" " + t for t, f in zip(texts, fast) if not f]))
        return [np.array(self.ranks.encode_ordinary(" " + t) if f else np.frombuffer(next(rest), "<u4"), np.int64) for t, f in zip(texts, fast)]

    def _encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def align(self, texts: list[str]) -> dict:
        """Per text: ``n_a, n_b, n_groups, n_links, groups_sha256`` and ``links`` (pairs ``a * |B| + b``, packed)."""
        n = len(texts)
        ids = self._encode_a(texts), self._encode_b(texts)
        want = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        whole = self._spelled_out(ids, want)
        out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64),
               "n_links": np.zeros(n, np.int64), "groups_sha256": [""] * n, "links": [b""] * n}
        if not whole:
            return out
        a, b = (np.concatenate([side[k] for k in whole]) for side in ids)
        n_a, n_b = (np.array([len(side[k]) for k in whole]) for side in ids)
        doc_a, doc_b = np.repeat(np.arange(len(whole)), n_a), np.repeat(np.arange(len(whole)), n_b)
        length_a, length_b = self.spelled[0].length[a], self.spelled[1].length[b]
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)  # documents lie one after another
        left = pd.DataFrame({"doc": doc_a, "start": end_a - length_a, "i": np.arange(len(a))})
        right = pd.DataFrame({"doc": doc_b, "start": end_b - length_b, "j": np.arange(len(b))})
        over = pd.merge_asof(left, right, on="start", by="doc")["j"].to_numpy()
        under = pd.merge_asof(right, left, on="start", by="doc")["i"].to_numpy()
        fresh = left["start"].to_numpy()[under] != right["start"].to_numpy()  # equal starts are found both ways
        pair = np.concatenate([a * len(self.bytes_b) + b[over], (a[under] * len(self.bytes_b) + b)[fresh]])
        doc = np.concatenate([doc_a, doc_b[fresh]])
        order = np.argsort(doc, kind="stable")
        pair, n_links = pair[order].astype(self.packed()), np.bincount(doc, minlength=len(whole))

        ends = np.zeros(int(end_a[-1]) + 1, np.int8)
        ends[end_a] += 1
        ends[end_b] += 1
        last_a, last_b = ends[end_a] == 2, ends[end_b] == 2
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = np.bincount(doc_a[last_a], minlength=len(whole))
        # a token stands after the other side's tokens of earlier groups, or, for B, of its own group as well
        until_a, until_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + np.concatenate([[0], until_b])[group_a]] = 2 * a + last_a
        said[np.arange(len(b)) + until_a[group_b]] = 2 * (len(self.bytes_a) + b) + last_b
        said, ends = self.listed.of(said)
        said, cuts = memoryview(said), np.concatenate([[0], ends[np.cumsum(n_a + n_b) - 1]]).tolist()
        link_cuts = np.concatenate([[0], np.cumsum(n_links)]).tolist()
        out["n_a"][whole], out["n_b"][whole], out["n_groups"][whole], out["n_links"][whole] = n_a, n_b, n_groups, n_links
        for r, k in enumerate(whole):
            out["groups_sha256"][k] = hashlib.sha256(said[cuts[r]:cuts[r + 1] - 1]).hexdigest()
            out["links"][k] = pair[link_cuts[r]:link_cuts[r + 1]].tobytes()
        return out

    def _spelled_out(self, ids: tuple, want: list[bytes]) -> list[int]:
        """The texts that the tokens of both sides spell out."""
        whole = range(len(want))
        for side, table in zip(ids, self.spelled):
            got, ends = table.of(np.concatenate(side) if side else np.zeros(0, np.int64))
            got = memoryview(got)
            if got != memoryview(b"".join(want)) or [0, *np.cumsum([len(w) for w in want]).tolist()] != self._cuts(side, ends):
                cuts = self._cuts(side, ends)
                whole = [k for k in whole if got[cuts[k]:cuts[k + 1]] == want[k]]
        return list(whole)

    @staticmethod
    def _cuts(side: list[np.ndarray], ends: np.ndarray) -> list[int]:
        return np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64)].tolist()

    def packed(self) -> np.dtype:
        """Four bytes a pair where all pairs of ids fit."""
        return np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<i8")


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept between its tasks."""
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = Aligner(path_a, path_b)
    return _WORKER[path_a, path_b]


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links`` per row of ``docs``.

    ``links`` holds the pairs ``a * |B| + b`` of all overlapping tokens, four bytes each (eight where the ids need it).
    Whole texts; null, empty and texts that either tokenizer's tokens do not spell out have none."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in runs(texts, BATCH_CHARS):
                some = [k for k in range(lo, hi) if texts[k]]
                got = aligner(path_a, path_b).align([texts[k] for k in some])
                at = np.array(some, np.int64) - lo
                cols = []
                for c in ("n_a", "n_b", "n_groups", "n_links"):
                    x = np.zeros(hi - lo, np.int64)
                    x[at] = got[c]
                    cols.append(pa.array(x))
                for c, none, kind in (("groups_sha256", "", pa.string()), ("links", b"", pa.binary())):
                    x = [none] * (hi - lo)
                    for k, v in zip(at.tolist(), got[c]):
                        x[k] = v
                    cols.append(pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + hi - lo)), b.column(0)[lo:hi], *cols],
                                                 names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                row += hi - lo

    return src.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _pairs_of(column, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a column of packed links, and how many each row has."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return (np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)), np.array([len(p) for p in parts], np.int64)


def pair_counts(found: DataFrame, kind: np.dtype, size_b: int, hold: int = 1 << 20) -> DataFrame:
    """``pair, count, best``: how many links hold each pair, and whether no pair of the same B id is in more.

    Tasks count up to ``hold`` pairs before they pass counts on; the maxima are one row per B id."""
    def run(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                new, n = np.unique(_pairs_of(b.column(0)[lo:lo + 2000], kind)[0], return_counts=True)
                both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > hold:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "count"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "count"])

    counts = found.select("links").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = written(counts.withColumn("b", F.col("pair") % size_b), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most one row per id of the vocabulary
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pairs from the least count on that ``most`` pairs reach at the most (steps of a twentieth of the logarithm)."""
    step = F.floor(F.log(F.col("count").cast("double")) * 20)
    room, least = most, math.inf
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("low")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["low"]
    return counts.where(F.col("count") >= (least if least < math.inf else (1 << 62)))


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    ``n_groups`` groups lie between the byte offsets where tokens of both end; ``groups_sha256`` digests their
    ids as ``a1,a2|b1;a3|b2,b3``.  ``n_links`` pairs of token occurrences overlap; ``n_best`` of them have a pair of ids
    that the corpus links most often among the pairs of its B id (ties included), and ``count_sum`` adds up
    the corpus-wide counts over the links.  Strings of special tokens inside texts are plain text.  Null and empty texts,
    and texts that the tokens of one side do not spell out byte by byte, have no tokens: zeros and an empty digest.  Rows
    stay rows: null and repeated ids need no care, other columns are not read.

    ``frequent`` bounds what is broadcast: so many pairs with their counts; all others are joined by pair."""
    sizes = aligner(path_a, path_b)
    kind, size_b = sizes.packed(), len(sizes.bytes_b)
    found = written(links(docs, path_a, path_b, id_col, text_col), "links")
    counts = written(pair_counts(found, kind, size_b), "pairs")
    top = _frequent(counts, frequent).orderBy("pair").toArrow()
    held = spark.sparkContext.broadcast((top["pair"].to_numpy(), top["count"].to_numpy(), top["best"].to_numpy()))

    def look(batches):
        keys, count, best = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                rows, some = b.column(0)[lo:lo + 2000], b.column(1)[lo:lo + 2000]
                pair, n = _pairs_of(some, kind)
                pair, at = np.unique(pair, return_inverse=True)
                doc = np.repeat(np.arange(len(n)), n)
                where = np.searchsorted(keys, pair)
                known = (where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == pair) if len(keys) else np.zeros(len(pair), bool)
                where[~known] = 0
                value = np.where(known, count[where], 0) if len(keys) else np.zeros(len(pair), np.int64)
                mark = known & best[where] if len(keys) else known
                sums = np.zeros(len(n), np.int64)
                np.add.at(sums, doc, value[at])
                rare = ~known[at]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(n)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(np.bincount(doc, mark[at], len(n)).astype(np.int64)), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(pair[at][rare]))], names=["row", "n_best", "count_sum", "rare"])

    looked = written(found.select("row", "links").mapInArrow(look, "row long, n_best long, count_sum long, rare array<long>"), "looked")
    rest = looked.select("row", F.explode("rare").alias("pair")).join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("count").alias("more_sum"))
    return found.drop("links").join(looked.drop("rare"), "row").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
