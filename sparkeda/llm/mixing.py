"""Mixing sources to target weights by pivotal dependent rounding (operator 4).

Every document of a source should appear ``target / source_size`` times.  The whole part is
given outright; the fractions are rounded in pairs: two documents pass words between each
other until one of them is in or out, at random but so that the words expected from the pair
and each document's own expectation stay as they are.  Pairs are worked off inside buckets
of a few dozen documents, each bucket leaves one unfinished document, and these residuals
go up a tree of buckets until one document per source is left.  Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sparkeda.llm.common import n_words, uniform, written
from sparkeda.operators.ordered import running

DEFAULT_WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, ratio: float = 1.5, weights=DEFAULT_WEIGHTS, cap: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` -> also ``target``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``ratio``
    times the sum of all sizes.  A target stops at ``cap`` times its source's size; the excess
    goes to the others by weight until none is above.  That fixed point is reached in one pass:
    sources ordered by cap per weight are capped as a prefix, and the rest share what is left."""
    from pyspark.sql import Window

    every = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    rank = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    s = s.select("*", F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("capped"),
                 F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("left_w"),
                 F.sum("source_size").over(Window.partitionBy()).alias("total"))
    level = (F.col("total") * F.lit(float(ratio)) - F.coalesce("capped", F.lit(0.0))) / F.col("left_w")
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("limit"), level))
    # the first source in that order that its share does not fill sets the level of all after it
    s = s.withColumn("level", F.min(F.struct(F.col("limit") / F.col("w"), F.col("source").isNull(), "source", "level"))
                     .over(Window.partitionBy(F.col("level").isNull())).getField("level"))
    s = s.withColumn("level", F.max("level").over(Window.partitionBy()))
    return s.select("source", "source_size",
                    F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, ratio: float = 1.5, weights=DEFAULT_WEIGHTS, cap: float = 2.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: int = 4, fan_in: int = 48) -> DataFrame:
    """One row per document: ``id, source, size, rep, source_size, target, copies, taken``.

    ``rep`` numbers rows that agree in id, source and size.  Sizes are words (null text: 0);
    a document of size 0 takes no words, its ``copies`` are drawn alone.  ``taken`` is
    ``copies * size``; copies never exceed ``ceil(cap)``.  A source's taken words differ from its target by less than
    one document.  The draw depends on the rows and ``seed`` only, so reruns agree.  Null ids
    and null sources are values like others; an empty table gives an empty result."""
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    units = written(units.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("rows"))
    sizes = written(sizes, "mix-sizes")
    targets = source_targets(sizes.select("source", "source_size"), ratio, weights, cap)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = written(
        targets.join(sizes.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2")))
        .select("source", "source_size", "target", F.floor(share).alias("whole"), (share - F.floor(share)).alias("p"),
                F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(fan_in))).alias("buckets")), "mix-targets")
    of = targets.select(F.struct("source").alias("k"), "whole", "p", "buckets")
    rows = _numbered(units).withColumn("k", F.struct("source")).join(of, "k")
    pivotal = (F.col("size") > 0) & (F.col("p") > 0)
    alone = rows.where(~pivotal).select("id", "source", "size", "rep",
                                        (uniform("id", "source", "rep", seed=seed + 1) < F.col("p")).cast("long").alias("extra"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "source", "size", "rep"), F.col("buckets"))
    level = rows.where(pivotal).select("source", bucket.alias("bucket"), F.struct("id", "size", "rep", "p").alias("unit"))
    depth = sizes.agg(F.max("rows")).first()[0] or 0
    buckets, parts = max(1, math.ceil(depth / fan_in)), [alone]
    for k in range(64):
        done = written(_rounds(level, seed + 2 + k), f"mix-level{k}")
        parts.append(done.select("source", F.explode("out").alias("o")).select(
            "o.id", "source", "o.size", "o.rep", F.col("o.extra").cast("long").alias("extra")))
        if buckets == 1:
            last = (uniform("left.id", "source", "left.rep", seed=seed) < F.col("left.p")).cast("long")
            parts.append(done.select("left.id", "source", "left.size", "left.rep", last.alias("extra")))
            break
        level = done.select("source", F.floor(F.col("bucket") / F.lit(fan_in)).alias("bucket"), F.col("left").alias("unit"))
        buckets = math.ceil(buckets / fan_in)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    of = targets.select(F.struct("source").alias("k"), "source_size", "target", "whole")
    out = out.withColumn("k", F.struct("source")).join(of, "k").withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("id", "source", "size", "rep", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def _numbered(units: DataFrame, run: int = 4096) -> DataFrame:
    """``units`` with a row for each of their ``n`` rows, numbered ``rep``; many alike are numbered by several tasks, a run of
    them at a time."""
    few = units.where(F.col("n") <= run).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    many = units.where(F.col("n") > run).withColumn("from", F.explode(F.expr(f"sequence(1L, n, {run}L)")))
    many = many.repartition("id", "source", "size", "from").withColumn("rep", F.explode(F.expr(f"sequence(from, least(n, from + {run - 1}L))")))
    return few.unionByName(many.select(*few.columns))


def _rounds(level: DataFrame, seed: int) -> DataFrame:
    """Work off one bucket: ``out`` has the documents that are decided, ``left`` the one that is not."""
    order = F.struct(F.xxhash64(F.lit(seed), "source", "unit").alias("h"), F.col("unit"))
    g = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(order)).alias("units"))
    # t.a = the unit carried along, t.b = the next one; t.d = what their meeting decided
    def decided(u, extra):
        return f"named_struct('id', {u}.id, 'size', {u}.size, 'rep', {u}.rep, 'extra', {extra})"

    def met(out, extra, left, p):
        moved = f"named_struct('id', {left}.id, 'size', {left}.size, 'rep', {left}.rep, 'p', least(1.0D, greatest(0.0D, {p})))"
        return f"named_struct('out', {decided(out, extra)}, 'left', {moved})"

    a, b = "t.a", "t.b"
    up = f"least(1.0D - {a}.p, {b}.p * {b}.size / {a}.size)"  # how far a may rise, b paying for it in words
    down = f"least({a}.p, (1.0D - {b}.p) * {b}.size / {a}.size)"
    draw = f"pmod(xxhash64({seed}, {a}.id, {a}.size, {a}.rep, {b}.id, {b}.size, {b}.rep), {1 << 53}L) / {float(1 << 53)}D"
    step = f"""CASE WHEN ({draw}) * ({up} + {down}) < {down}
        THEN IF(1.0D - {a}.p <= {b}.p * {b}.size / {a}.size,
                {met(a, 1, b, f"{b}.p - (1.0D - {a}.p) * {a}.size / {b}.size")},
                {met(b, 0, a, f"{a}.p + {b}.p * {b}.size / {a}.size")})
        ELSE IF({a}.p <= (1.0D - {b}.p) * {b}.size / {a}.size,
                {met(a, 0, b, f"{b}.p + {a}.p * {a}.size / {b}.size")},
                {met(b, 1, a, f"{a}.p - (1.0D - {b}.p) * {b}.size / {a}.size")})
        END"""
    pair = f"transform(array(named_struct('a', acc.left, 'b', x.unit)), t -> {step})[0]"
    fold = f"""aggregate(slice(units, 2, size(units)),
        named_struct('left', units[0].unit, 'out', slice(array({decided("units[0].unit", 0)}), 1, 0)),
        (acc, x) -> transform(array({pair}),
            d -> named_struct('left', d.left, 'out', array_append(acc.out, d.out)))[0])"""
    return g.select("source", "bucket", F.expr(fold).alias("f")).select("source", "bucket", "f.left", "f.out")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, columns unchanged.

    Texts are shuffled once, to meet what the plan says for all rows that agree in id, source and size; a hot group of
    such rows may be split, since the plan has one row for it.  Rows that all get the same number of copies are done
    then.  Only groups whose rows get different numbers are numbered, in chunks and by a hash of all columns but
    maps, so reruns agree.  Null ids, sources and texts are values like others; an empty table gives an empty result."""
    cols = docs.columns
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    plan = written(plan.select(F.struct("id", "source", "size").alias("k"), "rep", "copies"), "mix-plan")
    groups = written(plan.groupBy("k").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")), "mix-groups")
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(cols)], key.alias("k")).join(groups, "k").where("hi > 0")
    rows = written(rows, "mix-rows")
    mixed = rows.where("lo < hi")
    taken = rows.where("lo = hi").withColumn("copies", F.col("lo"))
    if not groups.where("lo < hi").isEmpty():
        hashed = [F.col(f.name) for f in rows.schema.fields if f.name not in ("k", "lo", "hi")
                  and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        mixed = running(mixed, ["k"], [F.xxhash64(*hashed)], {"rep": ("row_number", None)})
        mixed = mixed.withColumn("rep", F.col("rep").cast("long")).join(plan, ["k", "rep"])
        taken = taken.unionByName(mixed.select(*taken.columns))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        *[F.col(f"c{n}").alias(c) for n, c in enumerate(cols)])
