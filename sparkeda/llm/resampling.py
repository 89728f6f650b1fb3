"""Target-distribution importance resampling over hashed n-grams (operator 13).

Each document's words are joined by single spaces and scanned once: the running CRC-32 after every word is stored.
The CRC of any run of words follows from two of them, ``crc(b) = crc(ab) ^ shift(crc(a), len(b))``, where the
shift by so many bytes is linear over GF(2), so four table lookups a value (for up to 63 bytes) cancel
the prefix.  The features' buckets are written beside the document; counts, weights and the draw read those.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkeda.llm.common import runs, written

#: Bytes of a document that are scanned at a time.
PIECE = 4 << 20
SPACE = 0x20
#: Words are runs of ASCII letters and digits and of all bytes of other characters; only A-Z is lower-cased.
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b > 0x7F or chr(b).isalnum() else SPACE for b in range(256))


def _byte_table() -> np.ndarray:
    """The CRC-32 register after each byte (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()


def _four(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for each of the four bytes, applied to registers."""
    return table[0, crc & 255] ^ table[1, (crc >> 8) & 255] ^ table[2, (crc >> 16) & 255] ^ table[3, crc >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to 63 zero bytes, and by 64, 128, ... bytes."""
    one = np.arange(256, dtype=np.uint32)
    state = np.stack([one << np.uint32(8 * j) for j in range(4)])
    low = np.empty((64, 4, 256), np.uint32)
    for n in range(64):
        low[n] = state
        state = (state >> np.uint32(8)) ^ _BYTE[state & 255]
    high = [state]
    while len(high) < 26:
        high.append(_four(high[-1], high[-1]))
    return low, high


_LOW, _HIGH = _shift_tables()
_FLAT = _LOW.ravel()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs moved on by ``n`` bytes, as a prefix counts in a text that goes on for so long."""
    at = (n & 63) * 1024
    out = (_FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + ((crc >> 8) & 255)] ^ _FLAT[at + 512 + ((crc >> 16) & 255)]
           ^ _FLAT[at + 768 + (crc >> 24)])
    rest, k = n >> 6, 0
    while rest.any():
        some = np.flatnonzero(rest & 1)
        out[some] = _four(_HIGH[k], out[some])
        rest, k = rest >> 1, k + 1
    return out


def ngram_crcs(normal: bytes, order: int) -> list[np.ndarray]:
    """CRCs of all runs of 1 to ``order`` words of a text whose words stand between single spaces."""
    words = normal.replace(b" ", b"\n ").split(b"\n")  # each but the first with the space before it
    size = np.fromiter(map(len, words), np.int64, len(words))
    crc32 = zlib.crc32
    after = np.fromiter(accumulate(words, lambda crc, word: crc32(word, crc), initial=0), np.uint32, len(words) + 1)[1:]
    to = np.cumsum(size)
    begin = to - size
    begin[1:] += 1
    # the prefix before a word ends with a space: one step on from the word before
    last = after[:-1] ^ np.uint32(0xFFFFFFFF)
    before = np.concatenate([[np.uint32(0)], ((last >> np.uint32(8)) ^ _BYTE[(last ^ np.uint32(SPACE)) & 255]) ^ np.uint32(0xFFFFFFFF)])
    return [after[k:] ^ shifted(before[:len(before) - k], (to[k:] - begin[:len(begin) - k])) for k in range(min(order, len(words)))]


def _pieces(normal: bytes, order: int):
    """``(piece, words carried over)`` of a long text, cut at spaces; a piece begins with the last words of those before."""
    at, tail = 0, []
    while at < len(normal):
        end = normal.find(b" ", at + PIECE)
        end = len(normal) if end < 0 else end
        piece = normal[at:end]
        yield b" ".join([*tail, piece]), len(tail)
        tail = [*tail, *piece.rsplit(b" ", order)[-(order - 1):]][-(order - 1):] if order > 1 else []
        at = end + 1


class Features:
    """Buckets of the n-grams of texts."""

    def __init__(self, order: int = 2, buckets: int = 10_000):
        self.order, self.buckets = order, buckets
        self.kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def of(self, texts: list[str | None]) -> tuple[list[int], list[bytes]]:
        """For each text its number of words, and the buckets of its features (runs of words, repeats counted), packed."""
        normal = [b" ".join((t or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()) for t in texts]
        counts, out = [0] * len(texts), [b""] * len(texts)
        for lo, hi in runs(normal, PIECE):
            if len(normal[lo]) > PIECE and hi == lo + 1:
                counts[lo], out[lo] = self._long(normal[lo])
                continue
            some = [k for k in range(lo, hi) if normal[k]]
            if not some:
                continue
            n = [normal[k].count(b" ") + 1 for k in some]
            packed = [self._buckets(crc) for crc in ngram_crcs(b" ".join([normal[k] for k in some]), self.order)]
            at = 0
            for k, words in zip(some, n):  # runs that begin in a document and end in the next are no features
                counts[k] = words
                out[k] = b"".join([p[at:at + max(0, words - j)].tobytes() for j, p in enumerate(packed)])
                at += words
        return counts, out

    def _buckets(self, crc: np.ndarray) -> np.ndarray:
        return (crc % np.uint32(self.buckets)).astype(self.kind)

    def _long(self, normal: bytes) -> tuple[int, bytes]:
        words, parts = 0, []
        for piece, carried in _pieces(normal, self.order):
            found = ngram_crcs(piece, self.order)
            words += len(found[0]) - carried
            # a run inside the words carried over was a feature of the piece before
            parts += [self._buckets(crc)[max(0, carried - j):].tobytes() for j, crc in enumerate(found)]
        return words, b"".join(parts)


def features(docs: DataFrame, order: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_words, buckets`` per row: the buckets of all runs of 1 to ``order`` words, packed little-endian in
    two bytes each (four beyond 65,536 buckets).  Whole texts; null as empty."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        f, row = Features(order, buckets), TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in runs(texts, PIECE):
                counts, packed = f.of(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + hi - lo)), b.column(0)[lo:hi], pa.array(counts, pa.int64()),
                                                  pa.array(packed, pa.binary())], names=["row", "doc_id", "n_words", "buckets"])
                row += hi - lo

    return src.mapInArrow(run, "row long, doc_id long, n_words long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: features in each bucket; a task passes on one count per bucket."""
    kind = Features(1, buckets).kind

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=buckets) if len(x) > buckets else 0
            small = b"".join([x for x in b.column(0).to_pylist() if len(x) <= buckets])
            total += np.bincount(np.frombuffer(small, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))`` of each bucket, as one array."""
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
             / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).toArrow()  # one per bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def _weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's features (none: 0)."""
    kind, held = Features(1, len(gain)).kind, found.sparkSession.sparkContext.broadcast(gain)  # one long per bucket

    def run(batches):
        value = held.value
        for b in batches:
            n, sums = [], []
            for x in b.column(3).to_pylist():
                f = np.frombuffer(x, kind)
                n.append(len(f))
                sums.append(int(value[f].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(
                [s // k if k else 0 for s, k in zip(sums, n)], pa.int64())], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 25, seed: str = "7", min_words: int = 20,
             order: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``.

    Features are the runs of 1 to ``order`` words, hashed into ``buckets``; a bucket's gain is the logarithm of its share
    in ``target`` over that in ``docs``.  ``weight`` is the floored mean gain; ``score`` adds a Gumbel draw fixed by
    ``seed`` and the id, so the highest scores are a sample without replacement in proportion to the weights.  Of the N rows of
    ``min_words`` words or more, the floor(percent * N / 100) highest are ranked, ties to the smaller id; the others have
    a null rank.

    Null texts are empty: no features, weight 0.  Null ids draw as the empty string and lose ties; rows that repeat an id are
    rows of their own with one draw.  Empty tables give no rows, an empty target counts as no features.  Other columns are
    not read.  Nothing is sorted in one task: ranks are places in range partitions plus the rows of the partitions before."""
    found = written(features(docs, order, buckets, id_col, text_col), "features")
    aim = features(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text_col}`").alias("text")), order, buckets, "id", "text")
    gain = gains(spark, bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((draw.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = written(_weighed(found, gain).withColumn("score", F.col("weight") + gumbel), "scored")

    enough = F.col("n_words") >= min_words
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = written(scored.where(enough).repartitionByRange(parts, *by).sortWithinPartitions(*by)
                     .select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")), "ranked")
    ranked = ranked.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = ranked.groupBy("part").agg(F.count("*").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"))
    drawn = ranked.agg(F.floor(F.count("*") * percent / 100).alias("drawn"))
    rank = F.col("offset") + F.col("at") + 1
    ranked = ranked.join(F.broadcast(offsets), "part").crossJoin(F.broadcast(drawn)).withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, "rank").unionByName(scored.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))
