"""Metric-log scans (W8 running mean, W9 best-so-far, W10 patience).

A series can hold a large share of all rows, so no step gathers a whole
series in one task.  Two-level scan:

1. rows get consecutive ids in ``(series, order)`` order (range partitioned,
   no single-partition window) and are cut into chunks of at most ``chunk``
   rows; each chunk is one row holding its values (bounded array);
2. each chunk is summarised as a function of the value entering it: the
   running mean step ``m -> min(d*m + (1-d)*x, clip)`` composes to
   ``m -> min(A*m + B, C)``; the image of an entering 0 (re-seed) is kept
   apart as ``Z``;
3. the summaries compose associatively, so the entering value of every chunk
   comes from a two-level fold: summaries are composed per block of ``block``
   chunks, block summaries are folded per series (``chunk * block`` times
   fewer rows than the data), and each block is replayed from its entering
   value -- no group holds more than ``max(chunk, block)`` rows;
4. each chunk replays its rows from its entering value.
The same pattern then gives best-so-far flags and patience counters.

The composed form rounds differently from a row-by-row fold and does not see a
re-seed caused by a mean that becomes exactly 0 inside a chunk.  Its values are
therefore only first guesses: after the replay, every chunk whose entering value
differs in any bit from the value its predecessor ended with is replayed from
that value, until none differs (``settled_means``).  Entering values and ends
then agree along every series, so the result is the row-by-row fold itself.  The
step shrinks differences, so a round or two suffice; a series needs as many rounds
as it has chunks at the most.

A null or NaN value is no step: it keeps the running mean and counts as a
non-improvement; before the first value there is no mean (null).

Per-row work inside a chunk is a short Python loop over an Arrow batch
(pandas UDF); everything else is joins and grouping.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsumm.operators.collection import dense_ids
from qsumm.plans.joins import sized_broadcast
from qsumm.session import cut_lineage

DECAY = 0.99
CLIP = 12.0


def _missing(x) -> bool:
    return x is None or x != x


def running_mean_seq(values, decay: float = DECAY, clip: float = CLIP, start: float | None = None):
    """Reference fold (also used inside chunks): re-seed when the mean is exactly 0.
    A missing value is no step; the mean before any step is None."""
    m = None if _missing(start) else start
    out = []
    for x in values:
        if not _missing(x):
            m = min(x if m is None or m == 0 else m * decay + (1 - decay) * x, clip)
        out.append(m)
    return out


def _summary(values, decay, clip):
    a, b, c, z = 1.0, 0.0, math.inf, 0.0
    for x in values:
        if _missing(x):
            continue
        a, b, c = decay * a, decay * b + (1 - decay) * x, min(decay * c + (1 - decay) * x, clip)
        z = min(x if z == 0 else z * decay + (1 - decay) * x, clip)
    return a, b, c, z


def settled_means(chunks: DataFrame, series: str, decay: float, clip: float) -> DataFrame:
    """``chunks`` (series, __chunk, __vals, __m_in: guessed entering value, null for none) with
    ``__sm``, the exact running means: replays chunks until every entering value
    is, to the bit, the value the chunk before ended with."""
    kind = T.StructType([T.StructField("sm", T.ArrayType(T.DoubleType())), T.StructField("end", T.DoubleType())])

    @F.pandas_udf(kind)
    def replay(vals: pd.Series, m_in: pd.Series) -> pd.DataFrame:
        rows = []
        for v, start in zip(vals, m_in):
            out = running_mean_seq(list(v), decay, clip, start)
            rows.append((out, out[-1]))
        return pd.DataFrame(rows, columns=["sm", "end"])

    done = cut_lineage(chunks.withColumn("__r", replay("__vals", "__m_in")))
    while True:
        ends = done.select(series, (F.col("__chunk") + 1).alias("__chunk"), F.col("__r.end").alias("__true"))
        # The first chunk of a series has no predecessor and no entering value.
        open_ = (done.select(series, "__chunk", "__vals", "__m_in").join(ends, [series, "__chunk"], "left")
                 .where(~F.col("__m_in").eqNullSafe(F.col("__true"))))
        redo = cut_lineage(open_.select(series, "__chunk", F.struct(
            F.col("__true").alias("m_in"), replay("__vals", "__true").alias("r")).alias("__new")))
        if redo.isEmpty():
            return done.withColumn("__sm", F.col("__r.sm")).drop("__r")
        done = cut_lineage(done.join(redo, [series, "__chunk"], "left")
                           .withColumn("__m_in", F.when(F.col("__new").isNull(), F.col("__m_in")).otherwise(F.col("__new.m_in")))
                           .withColumn("__r", F.coalesce("__new.r", "__r")).drop("__new"))


def _two_level_starts(sums: DataFrame, series: str, key_type: str, cols, col_types, compose, step, init,
                      out_cols, out_types, block: int) -> DataFrame:
    """State entering every chunk from per-chunk summaries, in two levels so no
    group is larger than ``block`` rows: (1) compose the summaries of each block
    of chunks, (2) fold the block summaries per series (``block`` times fewer
    rows than chunks), (3) replay each block from its entering state.

    ``compose(rows)`` -> summary of a run of summaries; ``step(state, summary)``
    -> state after it; ``init`` enters the first chunk of a series."""
    b = sums.withColumn("__blk", F.floor(F.col("__chunk") / block).cast("long"))

    def typed(frame: pd.DataFrame, names, types) -> pd.DataFrame:
        for c, t in zip(names, types):
            if t == "long":
                frame[c] = frame[c].astype("Int64")
        return frame
    sum_schema = f"{series} {key_type}, __blk long, " + ", ".join(f"{c} {t}" for c, t in zip(cols, col_types))
    out_schema = ", ".join(f"{c} {t}" for c, t in zip(out_cols, out_types))

    def comp(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        summary = compose(list(zip(*[pdf[c] for c in cols])))
        return typed(pd.DataFrame([[pdf[series].iloc[0], pdf["__blk"].iloc[0], *summary]],
                                  columns=[series, "__blk", *cols]), cols, col_types)

    blocks = b.groupBy(series, "__blk").applyInPandas(comp, sum_schema)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__blk")
        state, rows = init, []
        for row in zip(pdf["__blk"], *[pdf[c] for c in cols]):
            rows.append([pdf[series].iloc[0], row[0], *state])
            state = step(state, row[1:])
        return typed(pd.DataFrame(rows, columns=[series, "__blk", *out_cols]), out_cols, out_types)

    entering = blocks.groupBy(series).applyInPandas(fold, f"{series} {key_type}, __blk long, {out_schema}")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        state = tuple(pdf[c].iloc[0] for c in out_cols)
        rows = []
        for row in zip(pdf["__chunk"], *[pdf[c] for c in cols]):
            rows.append([pdf[series].iloc[0], row[0], *state])
            state = step(state, row[1:])
        return typed(pd.DataFrame(rows, columns=[series, "__chunk", *out_cols]), out_cols, out_types)

    joined = b.join(sized_broadcast(entering), [series, "__blk"])
    return joined.groupBy(series, "__blk").applyInPandas(within, f"{series} {key_type}, __chunk long, {out_schema}")


def metric_scan(df: DataFrame, series: str, order, value: str, decay: float = DECAY, clip: float = CLIP,
                patience: int = 5, maximize: bool = False, chunk: int = 4096, block: int = 4096) -> DataFrame:
    """Adds ``smoothed`` (W8), ``is_best`` (W9: strictly better than every earlier
    smoothed value of the series), ``runs`` (non-improvements since the last
    best) and ``stop`` (W10: ``runs > patience``; never when ``patience <= 0``)."""
    order = [order] if isinstance(order, str) else list(order)
    base = df.select(series, *order, F.col(value).cast("double").alias("__v"))
    ided = dense_ids(base, [series, *order], "__gid")
    ided = ided.withColumn("__chunk", F.floor(F.col("__gid") / chunk).cast("long"))
    packed = F.struct(F.col("__gid"), *[F.col(o) for o in order], F.col("__v"))
    chunks = ided.groupBy(series, "__chunk").agg(F.sort_array(F.collect_list(packed)).alias("__rows"))
    chunks = cut_lineage(chunks.withColumn("__vals", F.transform("__rows", lambda z: z["__v"])))

    # -- W8: chunk summaries, series fold, replay
    sum_schema = T.StructType([T.StructField(n, T.DoubleType()) for n in ("A", "B", "C", "Z")])

    @F.pandas_udf(sum_schema)
    def summarize(vals: pd.Series) -> pd.DataFrame:
        rows = [_summary(list(v), decay, clip) for v in vals]
        return pd.DataFrame(rows, columns=["A", "B", "C", "Z"])

    sums = chunks.select(series, "__chunk", summarize("__vals").alias("__s")).select(series, "__chunk", "__s.*")
    key_type = df.schema[series].dataType.simpleString()

    def mean_step(state, sm):
        m = state[0]
        a, b_, c, z = sm
        return (z if m == 0 else min(a * m + b_, c),)

    def mean_compose(rows):
        a, b_, c, z = 1.0, 0.0, math.inf, 0.0
        for a2, b2, c2, z2 in rows:
            a, b_, c = a2 * a, a2 * b_ + b2, min(a2 * c + b2, c2)
            z = z2 if z == 0 else min(a2 * z + b2, c2)
        return a, b_, c, z

    starts = _two_level_starts(sums, series, key_type, ["A", "B", "C", "Z"], ["double"] * 4, mean_compose,
                               mean_step, (0.0,), ["__m_in"], ["double"], block)

    guessed = starts.withColumn("__m_in", F.nullif("__m_in", F.lit(0.0)))
    ch = settled_means(chunks.join(sized_broadcast(guessed), [series, "__chunk"]), series, decay, clip)

    # -- W9/W10: chunk best and position of its last improvement, series fold, replay
    better = (lambda x, y: x > y) if maximize else (lambda x, y: x < y)
    best_schema = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("pos", T.LongType())])

    @F.pandas_udf(best_schema)
    def chunk_best(sm: pd.Series, gids: pd.Series) -> pd.DataFrame:
        bests, poss = [], []
        for s, g in zip(sm, gids):
            b, p = None, None
            for v, gid in zip(s, g):
                if not _missing(v) and (b is None or better(v, b)):
                    b, p = v, gid
            bests.append(b)
            poss.append(p)
        return pd.DataFrame({"best": bests, "pos": poss})

    cb = ch.select(series, "__chunk", chunk_best("__sm", F.transform("__rows", lambda z: z["__gid"])).alias("__b"))
    cb = cb.select(series, "__chunk", "__b.best", "__b.pos")

    def best_step(state, sm):
        best, last = state
        b_, p_ = sm
        if b_ is None or pd.isna(b_):
            return state
        if best is None or pd.isna(best) or better(b_, best):
            return (b_, p_)
        return state

    def best_compose(rows):
        state = (None, None)
        for r in rows:
            state = best_step(state, r)
        return state

    bstarts = _two_level_starts(cb, series, key_type, ["best", "pos"], ["double", "long"], best_compose,
                                best_step, (None, None), ["__best_in", "__last_in"], ["double", "long"], block)
    out_schema = T.StructType([T.StructField("is_best", T.ArrayType(T.BooleanType())),
                               T.StructField("runs", T.ArrayType(T.LongType()))])

    @F.pandas_udf(out_schema)
    def replay_best(sm: pd.Series, gids: pd.Series, best_in: pd.Series, last_in: pd.Series) -> pd.DataFrame:
        flags, runs = [], []
        for s, g, b, last in zip(sm, gids, best_in, last_in):
            b = None if pd.isna(b) else b
            last = None if pd.isna(last) else int(last)
            f_row, r_row = [], []
            for v, gid in zip(s, g):
                best = not _missing(v) and (b is None or better(v, b))
                if best:
                    b, last = v, int(gid)
                f_row.append(best)
                r_row.append(None if last is None else int(gid) - last)
            flags.append(f_row)
            runs.append(r_row)
        return pd.DataFrame({"is_best": flags, "runs": runs})

    ch = ch.join(sized_broadcast(bstarts), [series, "__chunk"])
    ch = ch.withColumn("__o", replay_best("__sm", F.transform("__rows", lambda z: z["__gid"]), "__best_in", "__last_in"))
    z = F.arrays_zip(F.col("__rows").alias("r"), F.col("__sm").alias("smoothed"),
                     F.col("__o.is_best").alias("is_best"), F.col("__o.runs").alias("runs"))
    rows = ch.select(series, F.explode(z).alias("__z"))
    stop = (F.col("__z.runs") > patience) if patience > 0 else F.lit(False)
    return rows.select(series, *[F.col(f"__z.r.{o}").alias(o) for o in order], F.col("__z.r.__v").alias(value),
                       F.col("__z.smoothed").alias("smoothed"), F.col("__z.is_best").alias("is_best"),
                       F.col("__z.runs").alias("runs"), stop.alias("stop"))
