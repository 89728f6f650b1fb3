"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import dropped, scratch, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, name: str = "components", tidy: bool = False) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, component)`` with the smallest node
    of each component; nodes without an edge to another node do not appear.

    Each round replaces the edges by as many or fewer (the minimum of a neighbourhood is a
    partial aggregate, so a hub costs one row per task) and is written to the shared folder.
    The loop ends when a round changes nothing; the number of rounds grows with the
    logarithm of the longest path.  Null and equal ends are ignored.  With ``tidy`` a round's tables go once
    the next one is written, and the result is a ``scratch`` table."""
    keep = scratch if tidy else written
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = keep(e, name)
    before = None
    for _ in range(MAX_ROUNDS):
        large = keep(_large_star(e), name)
        small = keep(_small_star(large), name)
        if tidy:
            dropped(e, large)
        e = small
        n, children, digest = e.agg(F.count("*"), F.count_distinct("u"),
                                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == children and (n, digest) == before:
            break
        before = (n, digest)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if not tidy:
        return out
    out = scratch(out, name)
    dropped(e)
    return out


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get the smallest of them (edges have u > v)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    lifted = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lifted.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
