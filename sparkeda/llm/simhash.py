"""SimHash near-duplicates by anchor-point covering (operator 5).

A fingerprint has 64 bits, one per majority over the XXH64 hashes of its shingles.  The
anchors are the words of a covering code: the 64 bits are cut into segments, and an anchor
is a choice of one bit per segment, spread over it (a product of repetition codes).  The
nearest anchor of a fingerprint, its home, is the majority of each segment, so the covering
radius is the sum of half the segment lengths.  A fingerprint within ``distance`` bits of
another lies within radius plus ``distance`` of the other's home; of these anchors only those
matter that really are the home of something within ``distance`` bits, and each fingerprint
is replicated to exactly these.  At an anchor, the fingerprints at home are compared with all
that were sent there; every link turns up once, at the home of its smaller end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sparkeda.llm.common import written
from sparkeda.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of a text (A-Z lower-cased, words between ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # a very long text is unpacked in blocks
        ones += np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 keep: list[str] = ()) -> DataFrame:
    """``(id, fp)`` per row of ``docs``, then the columns ``keep`` as ``_llm_c0``, ``_llm_c1``, ...; fp is
    the fingerprint as a signed long."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                      *[F.col(f"`{c}`").alias(f"_llm_c{k}") for k, c in enumerate(keep)])

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), *b.columns[2:]],
                                             names=["id", "fp", *b.schema.names[2:]])

    rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    return src.mapInArrow(run, f"id long, fp long{rest}")


def _segments(n: int) -> list[int]:
    """Masks of n nearly equal runs of the 64 bits."""
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, distance: int = 2, segments: int | None = None) -> DataFrame:
    """Pairs ``(u, v)`` of distinct fingerprints ``fp`` (u < v) at ``distance`` bits or fewer, each once.

    ``segments`` sets the number of anchors, ``2 ** segments``; by default it follows the
    logarithm of the number of fingerprints so that an anchor's share stays about as large.
    The links are the same for any value; a fingerprint goes to about
    ``segments ** 2 / 5`` anchors at distance 2."""
    if segments is None:
        segments = min(32, max(6, math.ceil(math.log2(max(2, fps.count()))) - 4))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(tasks, "fp")  # few bytes, but each row becomes many: not for a few tasks
    home, costs = F.lit(0).cast("long"), []
    for k, mask in enumerate(_segments(segments)):
        ones, need = F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(mask)))), mask.bit_count() // 2 + 1
        home = home + F.when(ones >= need, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        # flips that turn this segment's majority, and the bit of the anchor that turns with it
        costs.append(F.struct(F.when(ones >= need, ones - (need - 1)).otherwise(F.lit(need) - ones).cast("int").alias("c"),
                              F.lit(1 << k).cast("long").alias("m")))
    fps = fps.select("fp", home.alias("home"), F.array(*costs).alias("costs"))
    # sets of segments whose flips together stay within the distance
    reach, ends = "array(named_struct('c', 0, 'm', 0L, 'last', 0))", f"transform(costs, (s, i) -> named_struct('c', s.c, 'm', s.m, 'last', i + 1))"
    for _ in range(distance):
        reach = (f"array_distinct(concat({reach}, flatten(transform({reach}, r -> transform(filter({ends}, "
                 f"s -> s.last > r.last AND r.c + s.c <= {distance}), s -> named_struct('c', r.c + s.c, 'm', r.m | s.m, 'last', s.last))))))")
    sent = fps.select(F.col("fp").alias("v"), F.explode(F.expr(f"transform({reach}, r -> home ^ r.m)")).alias("anchor"))
    at_home = fps.select(F.col("fp").alias("u"), F.col("home").alias("anchor"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return at_home.join(sent, (at_home.anchor == sent.anchor) & near).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", segments: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, fp, component, component_id``.

    Documents link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id
    that can be reached, the document's own included, ``component`` the smallest fingerprint.
    Equal fingerprints are one node, so a group of copies costs one row per task.  Texts without a
    word (null, empty) have fingerprint zero and link like any other; texts of fewer words than a
    shingle are one shingle.  Null ids stay and count only where a component has no other id.
    Repeated rows each get their row; an empty table gives an empty result."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    edges = links(nodes.select("fp"), distance, segments)
    comp = written(connected_components(edges, "simhash-links"), "simhash-components")
    nodes = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = written(nodes.join(smallest, "component").select("fp", "component", "component_id"), "simhash-labels")
    return fps.join(labels, "fp").select("id", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                segments: int | None = None) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id, columns unchanged.

    Where several rows share that id, their fingerprints tell which of them is in the component, and the
    smallest fingerprint (then text) stays."""
    d = written(near_duplicates(docs, shingle, distance, id_col, text_col, segments), "simhash-classes")
    mine = F.col("id").eqNullSafe(F.col("component_id"))
    ids = d.groupBy("id").agg(F.count("*").alias("n"), F.max(mine).alias("wins")).where("wins")
    ids = ids.select(F.struct("id").alias("_llm_key"), (F.col("n") > 1).alias("_llm_shared"))
    wins = docs.withColumn("_llm_key", F.struct(F.col(id_col).cast("long").alias("id"))).join(ids, "_llm_key")
    out = wins.where("NOT _llm_shared").select(*[F.col(f"`{c}`") for c in docs.columns])
    # rows that share an id
    again = fingerprints(wins.where("_llm_shared"), shingle, id_col, text_col, docs.columns)
    known = d.where(mine).select(F.struct("id", "fp").alias("_llm_key"), "component").distinct()
    again = again.withColumn("_llm_key", F.struct("id", "fp")).join(known, "_llm_key").withColumn("_llm_n", F.row_number().over(
        Window.partitionBy("component").orderBy("fp", f"_llm_c{docs.columns.index(text_col)}")))
    again = again.where("_llm_n = 1").select(*[F.col(f"_llm_c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return out.unionByName(again)
