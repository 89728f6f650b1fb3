"""Quality rules as a learned decision list (operator 7).

Sequential covering over the statistics of labelled documents: a rule is a conjunction of
threshold conditions, grown condition by condition for the highest information gain on two
thirds of the labelled rows and pruned on the rest; the rows it covers leave, and the next
rule is grown.  The ordered rules become one Spark conditional expression.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import ASCII_SPACE

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_digits"]
WINDOW = 5
#: Statistics that conditions compare with thresholds.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "n_words": "n_words",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def text_stats(text: str | None) -> tuple:
    """The counts named in ``STATS`` of one whole text (null: empty).  Upper case and digits are those of ASCII."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    repeated = 0
    if n > WINDOW:
        seen = Counter(zip(*[words[k:] for k in range(WINDOW)]))
        if len(seen) < n - WINDOW + 1:
            upto = 0  # words before this one are counted
            for k, w in enumerate(zip(*[words[k:] for k in range(WINDOW)])):
                if seen[w] > 1:
                    repeated += k + WINDOW - max(k, upto)
                    upto = k + WINDOW
    return (n, len(text) - _count(data, ASCII_SPACE.encode()), _count(data, SYMBOLS.encode()), len(lines) - len(set(lines)), repeated,
            _count(data, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _count(data, b"!?"), len(lines), _count(data, b"0123456789"))


def with_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and, as ``_llm_<name>``, the counts of each text."""
    keep = docs.columns if keep is None else keep
    cols = keep if text_col in keep else [*keep, text_col]
    src = docs.select(*[F.col(f"`{c}`").alias(f"_llm_c{k}") for k, c in enumerate(cols)])
    at, given = cols.index(text_col), [f"_llm_c{k} {t.dataType.simpleString()}" for k, t in enumerate(src.schema.fields[:len(keep)])]
    schema = ", ".join([*given, *[f"_llm_{s} long" for s in STATS]])
    n = len(keep)

    def run(batches):
        for b in batches:
            got = [text_stats(t.as_py()) for t in b.column(at)]
            counts = np.array(got, np.int64).reshape(-1, len(STATS)).T
            names = [*b.schema.names[:n], *[f"_llm_{s}" for s in STATS]]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(c) for c in counts]], names=names)

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"_llm_c{k}").alias(c) for k, c in enumerate(keep)], *[F.col(f"_llm_{s}") for s in STATS])


def _named(sql: str):
    """An expression over the counts, which carry a prefix in the frame."""
    for s in STATS:
        sql = re.sub(rf"\b{s}\b", f"_llm_{s}", sql)
    return F.expr(sql)


@dataclass(frozen=True)
class Rule:
    """Reject where every condition ``(feature, ">" or "<=", threshold)`` holds."""
    conditions: tuple

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, op, t in self.conditions:
            v = x[:, names.index(f)]
            hit &= v > t if op == ">" else v <= t
        return hit

    def expr(self):
        out = F.lit(True)
        for f, op, t in self.conditions:
            v = _named(FEATURES[f])
            out = out & (v > F.lit(t) if op == ">" else v <= F.lit(t))
        return out


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_conditions: int = 4, thresholds: int = 64,
                min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules that cover bad rows (``bad``: True).  Every third row prunes, the others grow.

    A rule joins the list if, on the rows not yet covered, at least ``min_precision`` of what
    it covers is bad, in the growing and in the pruning rows, and it covers ``min_covered``."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)

    def score(rule, rows):
        hit = rule.covers(x, names) & rows & left
        return (hit & bad).sum(), (hit & ~bad).sum()

    while (left & bad & ~prune).sum() >= min_covered:
        conditions: list = []
        rows = left & ~prune
        while len(conditions) < max_conditions:
            p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
            if n0 == 0 or p0 == 0:
                break
            best = (0.0, None, None)
            for k, f in enumerate(names):
                cuts = np.unique(np.quantile(x[rows, k], np.linspace(0, 1, thresholds + 2), method="lower"))
                if len(cuts) < 2:
                    continue
                cuts = (cuts[1:] + cuts[:-1]) / 2  # half way: room on either side
                above = x[rows, k][:, None] > cuts[None, :]
                for op, hit in ((">", above), ("<=", ~above)):
                    p, n = (hit & bad[rows][:, None]).sum(0), (hit & ~bad[rows][:, None]).sum(0)
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0)
                    at = int(np.argmax(gain))
                    if gain[at] > best[0] + 1e-9:
                        best = (gain[at], (f, op, float(cuts[at])), hit[:, at])
            if best[1] is None:
                break
            conditions.append(best[1])
            rows[np.flatnonzero(rows)[~best[2]]] = False
        options = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        if not options:
            break

        def worth(rule):
            p, n = score(rule, prune)
            return (p - n) / max(1, p + n), p
        rule = max(options, key=worth)
        (p, n), (pp, pn) = score(rule, ~prune), score(rule, prune)
        if p + pp < min_covered or p < min_precision * (p + n) or pp < min_precision * (pp + pn):
            break
        rules.append(rule)
        left &= ~rule.covers(x, names)
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = 20_000, **kw) -> list[Rule]:
    """Learn the list from labelled documents that the base rules let pass.

    Reads at most ``max_rows`` labels, chosen by the hash of their id; their documents' whole
    texts are counted.  Labels that are null, ids without a document and repeated labels that
    disagree are left out; without both classes the list is empty and every document passes."""
    few = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).cast("long").alias("_llm_id")).agg(F.min(label_col).alias("_llm_label"), F.max(label_col).alias("_llm_top"))
           .where("_llm_label = _llm_top").orderBy(F.xxhash64("_llm_id"), "_llm_id").limit(max_rows).select("_llm_id", "_llm_label"))
    some = docs.select(F.col(id_col).cast("long").alias("_llm_id"), F.col(text_col).alias("_llm_body")).join(
        F.broadcast(few), "_llm_id")  # max_rows rows of two numbers
    s = with_stats(some, "_llm_body", ["_llm_id", "_llm_label"]).where(~_named(BASE_FAILED))
    got = s.select("_llm_id", "_llm_label", *[_named(e).cast("double").alias(f) for f, e in FEATURES.items()]).orderBy(
        F.xxhash64("_llm_id"), "_llm_id", *FEATURES).limit(max_rows).collect()
    names = list(FEATURES)
    x = np.array([[r[f] for f in names] for r in got], float).reshape(-1, len(names))
    bad = np.array([r["_llm_label"] == 0 for r in got], bool)
    return learn_rules(x, bad, names, **kw) if bad.any() and not bad.all() else []


def verdict(rules: list[Rule]):
    """``kept`` as one conditional expression over the counts: the first rule that holds rejects."""
    out = F.when(_named(BASE_FAILED), F.lit(False))
    for r in rules:
        out = out.when(r.expr(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: ``id``, the counts of ``STATS``, ``base_failed`` and ``kept``."""
    rules = fit(docs, labels, id_col, text_col, **kw)
    s = with_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_llm_body")), "_llm_body", ["id"])
    return s.select("id", *[F.col(f"_llm_{k}").alias(k) for k in STATS],
                    _named(BASE_FAILED).alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that pass, columns unchanged; no shuffle of texts."""
    rules = fit(docs, labels, id_col, text_col, **kw)
    return with_stats(docs, text_col).where(verdict(rules)).select(*[F.col(f"`{c}`") for c in docs.columns])
