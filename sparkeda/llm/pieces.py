"""SentencePiece encoding and decoding in batches with numpy (operator 8).

A text is cut into words that no piece crosses, equal words are worked off once, and words of
equal length advance together: rolling hashes of all their substrings probe the sorted hashes
of the pieces, which gives for every place and length the piece there and its score.

* A unigram model takes the best path (Viterbi): the maxima over all pieces that end at a
  place are taken for all words at once and leave back pointers.
* A BPE model is not a best path over scores: the library merges, again and again, the two neighbours
  whose union has the highest score.  Its words do the same in step: one vectorised maximum per round
  finds every word's next merge.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import WordCache, runs, spaced_words

SPACE = "▁"
#: Words whose ids a worker remembers; more are encoded again.
CACHE_SIZE = 1_000_000
#: Longer words merge one by one with a heap; the result is the same.
LONG_WORD = 48
UNK_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORKER: dict = {}


class Model:
    """Pieces, scores and flags of a SentencePiece model file (identity normalisation)."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a character map, that keep white space, are read")
        self.unigram, self.dummy_prefix = m.trainer_spec.model_type == 1, n.add_dummy_prefix
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not read")
        self.pieces = [p.piece for p in m.pieces]
        normal = [(p.piece, k, p.score) for k, p in enumerate(m.pieces) if p.type == kinds.NORMAL]
        self.scores = {p: (k, s) for p, k, s in normal}
        self.unk = next(k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.unk_score = min((s for _, _, s in normal), default=0.0) - UNK_PENALTY
        self.longest = max(map(len, self.scores), default=1)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        # what an id reads back as
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL
                    else m.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.encode() for p in m.pieces]
        by_hash = sorted((int(_spread(_hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1:])[0]), p, k, s) for p, k, s in normal)
        self.keys = np.array([h for h, *_ in by_hash], np.uint64)
        if len(set(self.keys.tolist())) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.key_ids = np.array([k for _, _, k, _ in by_hash], np.int32)
        self.key_scores = np.array([s for *_, s in by_hash], np.float64)
        width = max(1, self.longest)
        self.key_chars = np.zeros((len(by_hash), width), np.uint32)
        for r, (_, p, _, _) in enumerate(by_hash):
            self.key_chars[r, :len(p)] = [ord(c) for c in p]
        self.key_len = np.array([len(p) for _, p, _, _ in by_hash], np.int32)
        # where the sorted hashes with each leading 16 bits begin
        self.key_from = np.searchsorted(self.keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int32)
        self.most_alike = int(np.diff(self.key_from).max())


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row (column 0: empty)."""
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + chars[:, j].astype(np.uint64) + np.uint64(1)
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    """The hashes of short words over all 64 bits; different ones stay different."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def probe(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: id and score of the piece at ``[word, start, length - 1]`` (id -1: none)."""
    n, size = chars.shape
    most = min(size, model.longest)
    ids, scores = np.full((n, size, most), -1, np.int32), np.full((n, size, most), -np.inf)
    if not len(model.keys):
        return ids, scores
    prefix, power = _hashes(chars), 1
    for length in range(1, most + 1):
        power = power * int(_BASE) % (1 << 64)
        h = _spread(prefix[:, length:] - prefix[:, :-length] * np.uint64(power))
        lead = (h >> np.uint64(48)).astype(np.int32)
        first, end = model.key_from[lead], model.key_from[lead + 1]
        w, s = np.nonzero(first < end)
        h, at, end = h[w, s], first[w, s], end[w, s]
        for _ in range(model.most_alike - 1):  # on to the key itself or the last of its lead
            at += (at + 1 < end) & (model.keys[at] != h)
        hit = (model.keys[at] == h) & (model.key_len[at] == length)
        w, s, at = w[hit], s[hit], at[hit]
        same = np.ones(len(at), bool)  # the characters decide, not the hash
        for c in range(length):
            same &= model.key_chars[at, c] == chars[w, s + c]
        w, s, at = w[same], s[same], at[same]
        ids[w, s, length - 1], scores[w, s, length - 1] = model.key_ids[at], model.key_scores[at]
    return ids, scores


def viterbi(model: Model, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Best paths of words of one length: at ``[word, start]`` the length of the piece that starts there (0: none)."""
    n, size, most = scores.shape
    scores = scores.astype(np.float32)  # as the library adds, so that equal sums are equal there too
    scores[:, :, 0][ids[:, :, 0] < 0] = model.unk_score
    best, back, rows = np.full((n, size + 1), -np.inf, np.float32), np.zeros((n, size + 1), np.int32), np.arange(n)
    best[:, 0] = 0
    for end in range(1, size + 1):
        reach = min(end, most)
        options = np.stack([best[:, end - k] + scores[:, end - k, k - 1] for k in range(1, reach + 1)], axis=1)
        # of equal paths the one with the longer last piece
        at = reach - 1 - np.argmax(options[:, ::-1], axis=1)
        best[:, end], back[:, end] = options[rows, at], at + 1
    length, end = np.zeros((n, size), np.int32), np.full(n, size)
    while len(rows):  # follow the back pointers, all words at once
        k = back[rows, end[rows]]
        end[rows] -= k
        length[rows, end[rows]] = k
        rows = rows[end[rows] > 0]
    return length


def merge(model: Model, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """BPE merges of words of one length, given as ``viterbi`` gives paths."""
    n, size, most = scores.shape
    length = np.ones((n, size), np.int32)  # of the symbol that starts here; 0 inside a symbol
    flat, starts = scores.reshape(n, -1), np.arange(size)[None, :]
    live = np.arange(n if size > 1 else 0)
    while len(live):
        here = length[live]
        after = starts + here  # where the next symbol starts
        inside = (here > 0) & (after < size)
        total = here + np.take_along_axis(here, np.minimum(after, size - 1), 1)
        fits = inside & (total <= most)
        options = np.where(fits, np.take_along_axis(flat[live], starts * most + np.clip(total, 1, most) - 1, 1), -np.inf)
        at = np.argmax(options, axis=1)  # of equal scores the leftmost
        pick = np.arange(len(live))
        go = options[pick, at] > -np.inf
        live, at, total, after = live[go], at[go], total[pick, at][go], after[pick, at][go]
        length[live, at], length[live, after] = total, 0
    return length


def path(ids: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, id)`` of the pieces of one word; id -1 is an unknown character."""
    return [(int(s), int(length[s]), int(ids[s, length[s] - 1])) for s in np.flatnonzero(length)]


def merge_long(model: Model, word: str) -> list[tuple[int, int, int]]:
    """The same merges for one long word, with a heap of neighbours: n log n steps."""
    size, known = len(word), model.scores
    right, left, length = list(range(1, size + 1)), list(range(-1, size - 1)), [1] * size
    heap: list = []

    def offer(a):
        b = right[a]
        if b < size:
            got = known.get(word[a:b + length[b]])
            if got:
                heapq.heappush(heap, (-got[1], a, length[a], length[b]))

    for a in range(size - 1):
        offer(a)
    while heap:
        _, a, x, y = heapq.heappop(heap)
        b = right[a]
        if length[a] != x or b >= size or length[b] != y:
            continue
        length[a], length[b], right[a] = x + y, 0, right[b]
        if right[b] < size:
            left[right[b]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    out, a = [], 0
    while a < size:
        out.append((a, length[a], known.get(word[a:a + length[a]], (-1,))[0]))
        a = right[a]
    return out


class Codec:
    """Encodes and decodes texts; remembers the ids of words."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        # words between single spaces or line feeds (which then begin them), and words with their escaped spaces
        self.plain_words = WordCache(cache_size, lambda ws: self.encode_words([w if w[0] == "\n" else SPACE + w for w in ws]))
        self.odd_words = WordCache(cache_size // 4, self.encode_words)
        self.plain = m.dummy_prefix and not m.crossing and not any("\n" in p for p in m.scores)
        self.ascii = np.array([m.bytes.get(b, -1) for b in range(128)], np.int32)

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """The words of a text, and whether they are those between single spaces and line feeds."""
        if self.plain and SPACE not in text:
            words = spaced_words(text)
            if words:
                words[0] = words[0][1:]
                return words, True
        if not text:
            return [], False
        text = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return [text] if self.model.crossing else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text), False

    def _ids(self, word: str, pieces: list[tuple[int, int, int]]) -> bytes:
        m, out = self.model, []
        for s, k, i in pieces:
            if i >= 0:
                out.append(i)
            elif m.bytes:
                out += [m.bytes[b] for b in word[s:s + k].encode("utf-8", "surrogatepass")]
            else:
                out.append(m.unk)
        return np.array(out, "<i4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, those of equal length together."""
        m, out = self.model, [b""] * len(words)
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for size, same in by_length.items():
            if size > LONG_WORD and not m.unigram:
                for k in same:
                    out[k] = self._ids(words[k], merge_long(m, words[k]))
                continue
            rows = max(1, 400_000 // (size * min(size, m.longest)))
            for at in range(0, len(same), rows):
                part = [words[k] for k in same[at:at + rows]]
                chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                ids, scores = probe(m, chars)
                length = viterbi(m, ids, scores) if m.unigram else merge(m, ids, scores)
                r, s = np.nonzero(length)
                got = ids[r, s, length[r, s] - 1]
                low = np.flatnonzero(got < 0)  # unknown characters: of ASCII one byte each, others later
                code = chars[r[low], s[low]]
                got[low] = np.where(code < 128, self.ascii[np.minimum(code, 127)], -1)
                data, ends = got.astype("<i4").tobytes(), (4 * np.cumsum(np.bincount(r, minlength=len(part)))).tolist()
                for k, i, j in zip(same[at:at + rows], [0, *ends], ends):
                    out[k] = data[i:j]
                for w in np.unique(r[got < 0]).tolist():
                    out[same[at + w]] = self._ids(part[w], path(ids[w], length[w]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        plain = iter(self.plain_words.texts([c for c, p in cut if p]))
        odd = iter(self.odd_words.texts([c for c, p in cut if not p]))
        out = [next(plain if p else odd) for _, p in cut]
        return out if self.model.bytes else [self._one_unk(x) for x in out]

    def _one_unk(self, ids: bytes) -> bytes:
        """Without byte pieces a run of unknown characters is one id."""
        a = np.frombuffer(ids, "<i4")
        return a[~((a == self.model.unk) & np.concatenate([[False], a[:-1] == self.model.unk]))].tobytes() if len(a) else ids

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _codec(path: str) -> Codec:
    """One per Python worker, kept between its tasks."""
    if path not in _WORKER:
        _WORKER[path] = Codec(path)
    return _WORKER[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all but the text), ``n_tokens`` and ``token_ids`` per row.

    ``model`` is a SentencePiece file that every executor can open.  Whole texts, null as empty; the empty
    text has no ids.  With ``digest`` the ids are replaced by ``ids_crc32`` (unsigned crc32 of them as
    little-endian 32-bit integers) and ``round_trip`` (their decoding is the text).  Rows stay rows: repeated and
    null ids need no care; kept columns whose names clash with the new ones are replaced by them."""
    new = ["n_tokens", "ids_crc32", "round_trip"] if digest else ["n_tokens", "token_ids"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text_col)]
    src = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(src.schema.fields[1:])]
    kinds += ["n_tokens long", "ids_crc32 long", "round_trip boolean"] if digest else ["n_tokens long", "token_ids array<int>"]

    def run(batches):
        codec = _codec(model)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in runs(texts, 2 << 20):
                ids = codec.encode(texts[lo:hi])
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, hi - lo)
                if digest:
                    same = [codec.decode(np.frombuffer(x, "<i4")) == t for x, t in zip(ids, texts[lo:hi])]
                    cols = [pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                else:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
                yield pa.RecordBatch.from_arrays([*[c[lo:hi] for c in b.columns[1:]], pa.array(counts), *cols],
                                                 names=[*b.schema.names[1:], *new])

    out = src.mapInArrow(run, ", ".join(kinds))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *new)


def decode(tokens: DataFrame, model: str, ids_col: str = "token_ids", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The rows of ``tokens`` with the text of the list of ids (null: null) in its place, or beside it with ``keep_ids``."""
    rest = [c for c in tokens.columns if c not in (ids_col, text_col)]
    src = tokens.select(F.col(f"`{ids_col}`").cast("array<int>").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    kinds = ", ".join([*[f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(src.schema.fields[1:])], *(["i array<int>"] if keep_ids else []), "t string"])

    def run(batches):
        codec = _codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = part.column(0)
                flat, at, none = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_null().to_pylist()
                texts = [None if no else codec.decode(flat[i:j]) for no, i, j in zip(none, at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *([ids] if keep_ids else []), pa.array(texts, pa.string())],
                                                 names=[*b.schema.names[1:], *(["i"] if keep_ids else []), "t"])

    out = src.mapInArrow(run, kinds)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)], *([F.col("i").alias(ids_col)] if keep_ids else []), F.col("t").alias(text_col))
