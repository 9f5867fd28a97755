"""Mixing sources to target weights by entropy balancing (DataFrame only).

The rates ``r`` of the documents of one source minimise the relative entropy
to the uniform rate 1 subject to ``sum(r * size) = target`` and ``0 <= r <=
cap``.  The dual has one multiplier per source, the rates are exponentially
tilted, ``r = min(cap, exp(lambda * size / scale))``, and Newton steps (kept
inside a bracket) solve ``sum(r * size) = target`` for all sources at once.

Documents of one source and size share a rate, so every iteration reads a
histogram (source, size, n) that Spark has pre-aggregated, never the documents:
a source with a third of all rows costs no more than its distinct sizes.
Rates are rounded to copies by systematic sampling of the fractions in order of
size, the rest (less than one document) is corrected greedily, and copies are
dealt to documents by a hash rank that gathers no group.

Defined results: null text has size 0; null source is a source, last in order;
documents of size 0 get 0 copies; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rows

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 16
FIX_ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: ``share`` of all sizes
    by weight, no target above ``cap`` times its size, the excess reshared.

    The water level ``t`` (target per weight) is the one at which the capped
    targets add up; sources are capped in ascending ``cap * size / weight``."""
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("lim", F.col("source_size") * F.lit(float(cap)))
    total = W.partitionBy()
    by = W.orderBy(F.col("lim") / F.col("w"), F.col("source").isNull(), "source")
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("goal", F.sum("source_size").over(total) * F.lit(float(share)))
         .withColumn("capped", F.coalesce(F.sum("lim").over(upto), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(total) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
         .withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open_w"))
         .withColumn("free", F.col("level") * F.col("w") < F.col("lim")))
    # The first source in that order which stays below its limit sets the level of all after it.
    s = s.withColumn("t", F.min(F.when(F.col("free"), F.struct("capped", "level"))).over(total)["level"])
    return s.select("source", "source_size",
                    F.when(F.col("t").isNull(), F.col("lim"))
                    .otherwise(F.least(F.col("lim"), F.col("t") * F.col("w"))).alias("target"))


def solve(hist: DataFrame, goals: DataFrame, cap: float, steps: int = NEWTON_STEPS) -> DataFrame:
    """Multipliers per source: (source, lam, scale).  ``hist``: source, size, n."""
    scale = F.sum(F.col("n") * F.col("size")) / F.sum("n")
    state = (hist.groupBy("source").agg(scale.alias("scale"), F.min("size").alias("least"),
                                        (F.sum(F.col("n") * F.col("size")) * float(cap)).alias("most"))
             .withColumnRenamed("source", "s0")
             .join(goals, F.col("s0").eqNullSafe(F.col("source"))).drop("s0")
             .withColumn("lo", F.lit(-1e4))
             .withColumn("hi", F.log(F.lit(float(cap))) * F.col("scale") / F.col("least"))
             .withColumn("lam", F.when(F.col("target") >= F.col("most") - 0.5, F.col("hi")).otherwise(0.0)))
    state = rows.stage(state.select("source", "target", "scale", "lam", "lo", "hi"), "mix-state")
    h = hist.withColumnRenamed("source", "hs")
    for step in range(steps):
        x = F.col("size") / F.col("scale")
        r = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        token = F.col("n") * F.col("size")
        got = (h.join(state, F.col("hs").eqNullSafe(F.col("source")))
               .groupBy("source", "target", "scale", "lam", "lo", "hi")
               .agg(F.sum(token * F.least(r, F.lit(float(cap)))).alias("f"),
                    F.sum(F.when(r < cap, token * x * r).otherwise(0.0)).alias("g")))
        lo = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(F.col("f") - F.col("target"), F.col("g"))
        state = (got.withColumn("lo2", lo).withColumn("hi2", hi)
                 .withColumn("nw", newton)
                 .withColumn("err", F.abs(F.col("f") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
                 .withColumn("lam", F.when(F.col("err") < 1e-12, F.col("lam"))
                             .when((F.col("nw") >= F.col("lo2")) & (F.col("nw") <= F.col("hi2")), F.col("nw"))
                             .otherwise((F.col("lo2") + F.col("hi2")) / 2))
                 .select("source", "target", "scale", "lam", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "err"))
        if step % 4 == 3:
            state = rows.stage(state, "mix-state")
            if (state.agg(F.max("err")).first()[0] or 0.0) < 1e-9:
                break
            state = state.drop("err")
        else:
            state = state.drop("err")
    return state.select("source", "target", "scale", "lam")


def copies(hist: DataFrame, solved: DataFrame, cap: int, rounds: int = FIX_ROUNDS) -> DataFrame:
    """Whole copies per (source, size): adds ``k`` with ``0 <= k <= cap * n``."""
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(cap)))
    h = (hist.withColumnRenamed("source", "hs")
         .join(solved, F.col("hs").eqNullSafe(F.col("source")))
         .withColumn("want", F.round(F.col("n") * rate, 6))
         .withColumn("whole", F.floor("want")))
    frac = F.round(F.col("want") - F.col("whole"), 6)
    w = W.partitionBy("source").orderBy("size")
    run = F.sum(frac).over(w.rowsBetween(W.unboundedPreceding, 0))
    prev = F.coalesce(F.sum(frac).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    h = h.withColumn("k", (F.col("whole") + F.floor(run + 0.5) - F.floor(prev + 0.5)).cast("long"))
    h = h.withColumn("k", F.least(F.greatest(F.col("k"), F.lit(0)), F.col("n") * cap))
    h = rows.stage(h.select("source", "size", "n", "target", "k"), "mix-copies")
    every = W.partitionBy("source")
    for _ in range(rounds):
        gap = F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(every)).cast("long")
        h = h.withColumn("gap", gap)
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k"))
        fits = (room > 0) & (F.col("size") <= F.abs(F.col("gap")))
        h = h.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(every))
        move = F.least(room, F.floor(F.abs(F.col("gap")) / F.col("size")))
        h = (h.withColumn("k", F.when(F.col("size") == F.col("pick"),
                                      F.col("k") + F.signum(F.col("gap")).cast("long") * move)
                          .otherwise(F.col("k")))
             .drop("gap", "pick"))
    return h


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: the document's columns ``id_col``, ``source``,
    ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``cap``), and the
    row key (``ka``, ``kb``) with its number of repeats folded in: repeated
    rows come out once each."""
    slim = rows.keyed(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), *rows.KEY)
    slim = rows.stage(slim, "mix-sizes")
    hist = rows.stage(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    goals = rows.stage(targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
                               weights, share, cap), "mix-goals")
    live = hist.where(F.col("size") > 0)
    solved = solve(live, goals.select("source", "target"), cap)
    k = rows.stage(copies(live, solved, cap).select(
        F.col("source").alias("cs"), F.col("size").alias("csize"), "n", "k"), "mix-k")
    ranked = rows.dense_rank_of(slim, ["source", "size"], [F.col("ka"), F.col("kb")], "rk")
    g = goals.withColumnRenamed("source", "gs")
    got = F.floor(F.col("k") / F.col("n")) + F.when(F.col("rk") < F.col("k") % F.col("n"), 1).otherwise(0)
    return (ranked.join(k, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("csize")), "left")
            .join(g, F.col("source").eqNullSafe(F.col("gs")), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce(got, F.lit(0)).cast("long").alias("copies"), *rows.KEY))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it.

    Copies are joined back on the row key.  Rows that repeat one another share
    a key and are interchangeable: each gives the whole part of their mean
    copies, and one of them gives the remainder."""
    plain, names = rows.hidden(docs)
    keyed = rows.keyed(plain, names[id_col], names[text_col], names[source_col])
    taken = (mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
             .groupBy(*rows.KEY).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_same"))
             .where("_all > 0"))
    taken = rows.stage(taken, "mix-taken")
    each = F.floor(F.col("_all") / F.col("_same")).cast("int")
    whole = (keyed.join(taken.withColumn("_each", each).where("_each > 0"), list(rows.KEY))
             .withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_each")))))
    rest = taken.where("_same > 1").withColumn("_rest", (F.col("_all") % F.col("_same")).cast("int")).where("_rest > 0")
    extra = (keyed.join(rest, list(rows.KEY)).groupBy(*rows.KEY)
             .agg(F.first("_rest").alias("_rest"), *[F.first(c).alias(c) for c in plain.columns])
             .withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_rest")))))
    return rows.shown(whole.select(*plain.columns).unionByName(extra.select(*plain.columns)), names)
