"""Token ids in Parquet files (operator 2).

Documents in ascending order of their id, one row each: metadata columns beside a list column
of token ids.  Ids are dictionary-encoded per column chunk, counts and offsets delta-encoded
(Parquet format version 2); row groups and pages have a set size, and each page's bounds of the
id are in the file's page index.  Readers that want counts never touch the token column, and a
range of ids reads the pages that hold it.
"""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkeda.llm.common import WordCache, runs, spaced

#: Words whose ids a worker remembers; more are encoded again.
CACHE_SIZE = 1_200_000
#: Closing punctuation, and the first character after the Latin letters that every Unicode version agrees on.
TAIL, LATIN_END = string.punctuation, 0x250
#: A word of Latin letters, with a line feed before it perhaps, and the punctuation that closes it.
_LATIN = re.compile("(\n?[%s]+)([%s]*)" % ("".join(c for c in map(chr, range(LATIN_END)) if c.isalpha()), re.escape(TAIL))).fullmatch
_WORKER: dict = {}


def byte_letters() -> np.ndarray:
    """The letter that a byte-level vocabulary has for each byte; those that don't print are numbered from 256 on."""
    letters, prints = np.arange(256, dtype="<u2"), {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in prints]
    letters[other] = np.arange(256, 256 + len(other))
    return letters


BYTE_LETTERS = byte_letters()


class Encoder:
    """``tokenizers`` encoding that works each distinct word off once where the pre-tokenizer is byte-level.

    Strings of added tokens inside texts become those tokens, as the library has it by default; with
    ``special_as_text`` those of special tokens are ordinary text.

    Where words stand between single spaces or line feeds, a word with the space before it is a run of
    whole pre-tokens, and a line feed before a word is one of its own; so a text's ids are those of its
    words, in order.  Words whose pre-tokens are plain go straight to the tokenizer's model; other words
    pass its pre-tokenizer.  Other texts, and all texts of other tokenizers, are encoded as they are."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        # texts that hold one of these pass the library whole
        self.added = [] if special_as_text and all(t.special for t in self.tok.get_added_tokens_decoder().values()) else [
            t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words, self.tails = WordCache(cache_size, self._learn), {}
        model, pre = self.tok.model, self.tok.pre_tokenizer
        self.by_word = (self.tok.normalizer is None and isinstance(model, models.BPE) and isinstance(pre, pre_tokenizers.ByteLevel)
                        and pre.use_regex and not pre.add_prefix_space and not model.dropout
                        and not model.continuing_subword_prefix and not model.end_of_word_suffix)
        if self.by_word:
            (self.feed,) = self.tok.encode("\n", add_special_tokens=False).ids
            # the model alone, for pre-tokens in the vocabulary's letters with a line feed's between them
            self.bare = Tokenizer(model)
            self.bare.pre_tokenizer = pre_tokenizers.Split(chr(BYTE_LETTERS[10]), "isolated")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of words of Latin letters, after a space or after a line feed."""
        out, feed = [], np.array([self.feed], "<u4").tobytes()
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            lines = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in part])
            letters = BYTE_LETTERS[np.frombuffer(lines.encode("utf-8"), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
            cuts, ids = 4 * np.flatnonzero(ids == self.feed), ids.tobytes()
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep line feeds apart")
            out += [feed + ids[i:j] if w[0] == "\n" else ids[i:j] for w, i, j in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(ids)])]
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """After a space or a line feed, a word of Latin letters is one pre-token and punctuation that closes it
        another: the ids of the two, known or not, are the word's.  Other words as they are."""
        known, parts, fresh, tails = self.words.known, list(map(_LATIN, new)), {}, self.tails
        parts = [m and m.groups() for m in parts]
        for p in parts:
            if p:
                if p[0] not in known:
                    fresh[p[0]] = None
                if p[1] not in tails:
                    (tails[p[1]],) = self._whole([p[1]])
        fresh = dict(zip(fresh, self._plain(list(fresh))))
        other = iter(self._encode([w for w, p in zip(new, parts) if not p]))
        return [(fresh.get(p[0]) or known[p[0]]) + tails[p[1]] if p else next(other) for p in parts]

    def _encode(self, new: list[str]) -> list[bytes]:
        out, feed = [b""] * len(new), np.array([self.feed], "<u4").tobytes()
        for before, first in ((" ", b""), ("", feed)):  # words after a space, words after a line feed
            same = [k for k, w in enumerate(new) if (w[0] == "\n") == (not before)]
            for at in range(0, len(same), 5000):
                part = same[at:at + 5000]
                (ids,) = self._whole(["\n".join([before + new[k].lstrip("\n") for k in part])])
                cuts = 4 * np.flatnonzero(np.frombuffer(ids, "<u4") == self.feed)
                if len(cuts) != len(part) - 1:
                    raise ValueError("the tokenizer does not keep line feeds apart")
                for k, i, j in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(ids)]):
                    out[k] = first + ids[i:j]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._whole(texts)
        lines = [None if any(x in t for x in self.added) else spaced(t) for t in texts]
        odd = iter(self._whole([t for t, x in zip(texts, lines) if not x]))
        plain = iter(self._by_word([x for x in lines if x]))
        return [next(plain) if x else next(odd) for x in lines]

    def _by_word(self, lines: list[str]) -> list[bytes]:
        """The ids of ``spaced`` texts: each different word of them is looked up once."""
        if not lines:
            return []
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        codes = words.values.dictionary_encode()
        ids = self.words.each(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, first = codes.indices.to_numpy(), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat((first[at] - ends[:-1]).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        flat = np.frombuffer(b"".join(ids), "<u4")[place]
        cuts = ends[words.offsets.to_numpy()].tolist()
        return [flat[i + 1:j].tobytes() for i, j in zip(cuts, cuts[1:])]  # without the first word's line feed


def _encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
                      partitions: int | None = None) -> None:
    """Write the token files of ``docs`` to the folder ``path``.

    ``tokenizer`` is a file of the tokenizers library that every executor can open.  Columns:
    ``part`` and ``pos`` (file and place in it, in ascending order of the id over all files),
    ``doc_id``, ``before`` (ids of the part's earlier documents), ``n_tokens`` and ``tokens``.
    Every document ends with ``end_id``; a null text is empty.  Null ids come first; repeated ids
    are ordered by the hash of their text.  Spark's writer commits whole tasks, so a lost executor leaves no
    half file."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, pos, before = TaskContext.get().partitionId(), 0, 0
        for b in (b.slice(k, 800) for b in batches for k in range(0, b.num_rows, 800)):  # few texts are Python strings at a time
            texts = b.column(1).to_pylist()
            for lo, hi in runs(texts, 4 << 20):
                ids = [x + end for x in _encoder(tokenizer).encode(texts[lo:hi])]
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, hi - lo)
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                                  pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(pos, pos + hi - lo)), b.column(0)[lo:hi],
                    pa.array(before + ends - counts), pa.array(counts), tokens],
                    names=["part", "pos", "doc_id", "before", "n_tokens", "tokens"])
                pos, before = pos + hi - lo, before + int(ends[-1])

    out = src.mapInArrow(run, "part int, pos long, doc_id long, before long, n_tokens long, tokens array<int>")
    (out.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", "true").option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows).option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens`` and, if asked for, ``tokens`` of all documents in the files.

    ``start`` counts the ids of all documents before this one: the totals of the parts (one row per
    file) are summed up and joined to the rows.  Filters on ``doc_id`` reach the page index."""
    kinds = "part int, pos long, doc_id long, before long, n_tokens long, tokens array<int>"
    d = spark.read.schema(kinds).parquet(path)
    totals = d.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"))
    # one row per file, whose number the writer set: broadcast, so that the tokens are not shuffled
    return d.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens",
                                          *(["tokens"] if tokens else []))


def with_crc32(tokens: DataFrame, col: str = "tokens", to: str = "ids_crc32") -> DataFrame:
    """Replace a list of ids by the unsigned crc32 of them as little-endian unsigned 32-bit integers."""
    rest = [c for c in tokens.columns if c != col]
    kinds = ", ".join([*[f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in rest], f"`{to}` long"])

    def run(batches):
        for b in batches:
            ids = b.column(len(rest))
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array(crc, pa.int64())], names=[*rest, to])

    return tokens.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{col}`")).mapInArrow(run, kinds)
