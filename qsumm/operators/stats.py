"""Descriptive statistics and tests.

Everything is an aggregate with map-side partial combine.  Exact medians use
``percentile`` whose buffer holds one entry per *distinct* value; token and
sentence counts have a small value range, so a hot group stays small.
Global ranks (Wilcoxon) use range partitioning plus per-partition offsets,
never a single-partition window over all rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from qsumm.plans.joins import sized_broadcast
from qsumm.session import cut_lineage


def describe(df: DataFrame, keys, value: str, prefix: str, digits: int = 6) -> DataFrame:
    """Count, mean, exact median and population standard deviation."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(v), digits).alias(f"{prefix}_mean"),
        F.round(F.percentile(v, 0.5), digits).alias(f"{prefix}_median"),
        F.round(F.stddev_pop(v), digits).alias(f"{prefix}_std"),
    )


def histogram(df: DataFrame, key: str) -> DataFrame:
    """A4: value counts, most frequent first (ties by value)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(key))


def running_offsets(df: DataFrame, order_cols, weight: str | None = None, name: str = "__before") -> DataFrame:
    """For every row, the total ``weight`` (1 when None) of rows strictly before it in
    ``order_cols`` order (a unique key).  Range partitioning + per-partition
    prefix sums; only one row per partition ever meets in a single window."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wcol = F.col(weight) if weight else F.lit(1)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)  # sampled once by the range partitioner, then shuffled
    ranged = (src.repartitionByRange(n_parts, *order_cols)
              .withColumn("__pid", F.spark_partition_id()).withColumn("__w", wcol.cast("double")))
    ranged = cut_lineage(ranged)
    src.unpersist()
    inpart = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__loc", F.coalesce(F.sum("__w").over(inpart), F.lit(0.0)))
    totals = ranged.groupBy("__pid").agg(F.sum("__w").alias("__tot"))
    prior = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("__off", F.coalesce(F.sum("__tot").over(prior), F.lit(0.0)))
    out = local.join(F.broadcast(offs.select("__pid", "__off")), "__pid")
    return out.withColumn(name, F.col("__off") + F.col("__loc")).drop("__pid", "__w", "__loc", "__off")


def rolled_up(counts: DataFrame, keys: list, value: str) -> DataFrame:
    """Counts ``c`` per ``(keys, value)`` summed at every level of the keys, from all keys
    down to none: ``level`` is the number of keys kept, dropped keys are null."""
    sets = [[*keys[:k], value] for k in range(len(keys), -1, -1)]
    level = sum((1 - F.grouping(k) for k in keys), F.lit(0)).cast("int")
    return counts.groupingSets(sets, *keys, value).agg(level.alias("level"), F.sum("c").alias("c"))


def rollup_describe(df: DataFrame, keys, value: str, prefix: str, digits: int = 6) -> DataFrame:
    """A6 at every level of ``keys``: ``(level, keys, n)``, mean, exact median and population
    standard deviation of a whole-number column (null values count nowhere).

    Rows become counts per distinct value before anything else; levels, moments and medians
    come from those.  The median is the value under the middle ranks, found by running
    totals over the range-partitioned counts, so no task holds all values of a group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = (df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("v"))
              .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    cells = rolled_up(counts, keys, "v").withColumn("g", F.to_json(F.struct("level", *keys)))
    ranked = running_offsets(cells, ["g", "v"], "c")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    groups = ranked.groupBy("g").agg(
        F.first("level").alias("level"), *[F.first(k).alias(k) for k in keys],
        F.sum("c").alias("n"), F.min("__before").alias("start"),
        F.sum(big("v") * big("c")).alias("s1"), F.sum(big("v") * big("v") * big("c")).alias("s2"))
    # ranks from 0; the middle ones are (n - 1) / 2 and n / 2, rounded down
    at = ranked.select("g", "v", "c", "__before").join(groups.select("g", "n", "start"), "g")
    at = at.withColumn("lo", F.col("__before") - F.col("start")).withColumn("hi", F.col("lo") + F.col("c"))
    holds = lambda rank: (F.col("lo") <= rank) & (rank < F.col("hi"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    median = at.where(holds(low) | holds(high)).groupBy("g").agg(
        ((F.min("v") + F.max("v")) / 2.0).alias("median"))
    n, s1, s2 = F.col("n").cast("double"), F.col("s1").cast("double"), F.col("s2").cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n)))
    return groups.join(median, "g").select(
        "level", *keys, F.col("n").cast("long").alias("n"), F.round(s1 / n, digits).alias(f"{prefix}_mean"),
        F.round("median", digits).alias(f"{prefix}_median"), F.round(spread, digits).alias(f"{prefix}_std"))


def average_ranks(values: DataFrame, value: str) -> DataFrame:
    """``(value, cnt, avg_rank)`` per distinct value: ranks 1..n, ties get the mean."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    before = running_offsets(counts, [value], "cnt")
    return before.withColumn("avg_rank", F.col("__before") + (F.col("cnt") + 1) / 2.0).drop("__before")


def wilcoxon(pairs: DataFrame, x: str = "x", y: str = "y", group: str | None = None, digits: int = 6) -> DataFrame:
    """Signed-rank statistic between paired samples (zero differences dropped,
    mean ranks for ties, ``T = min(W+, W-)``, normal z with tie correction), one
    row per ``group`` (all groups ranked in one pass).  Columns ``n, w_plus,
    w_minus, t_stat, z``; ``with_p_value`` adds p."""
    g = [group] if group else []
    d = pairs.select(*g, (F.col(x) - F.col(y)).alias("d")).where(F.col("d") != 0)
    d = d.withColumn("ad", F.abs("d")).withColumn("pos", (F.col("d") > 0).cast("int"))
    by_abs = d.groupBy(*g, "ad").agg(F.count(F.lit(1)).alias("c"), F.sum("pos").alias("c_pos"))
    ranked = running_offsets(by_abs, [*g, "ad"], "c")
    if g:
        starts = ranked.groupBy(*g).agg(F.min("__before").alias("__start"))
        ranked = ranked.join(sized_broadcast(starts), g).withColumn("__before", F.col("__before") - F.col("__start"))
    ranked = ranked.withColumn("avg_rank", F.col("__before") + (F.col("c") + 1) / 2.0)
    agg = ranked.groupBy(*g).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("avg_rank") * F.col("c_pos")).alias("w_plus"),
        F.sum(F.col("avg_rank") * (F.col("c") - F.col("c_pos"))).alias("w_minus"),
        F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    t = F.least("w_plus", "w_minus")
    return agg.select(
        *g,
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        F.round(F.coalesce("w_plus", F.lit(0.0)), digits).alias("w_plus"),
        F.round(F.coalesce("w_minus", F.lit(0.0)), digits).alias("w_minus"),
        F.round(F.coalesce(t, F.lit(0.0)), digits).alias("t_stat"),
        F.round(F.when(var > 0, (t - mean) / F.sqrt(var)), digits).alias("z"),
        F.coalesce(F.col("ties"), F.lit(0)).cast("long").alias("tie_term"),
    )


def _exact_two_sided(n: int, t: float) -> float:
    """P(W <= t) doubled (at most 1) under the null distribution of the
    signed-rank sum, rank by rank; ``n`` steps over an array of n(n+1)/2 cells."""
    chance = np.zeros(n * (n + 1) // 2 + 1)
    chance[0] = 1.0
    for k in range(1, n + 1):
        moved = np.zeros_like(chance)
        moved[k:] = chance[:-k]
        chance = (chance + moved) / 2.0
    return min(1.0, 2.0 * float(chance[: int(math.floor(t)) + 1].sum()))


@F.pandas_udf(T.DoubleType())
def _exact_p(n: pd.Series, t: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(nn) or nn == 0 or tie else _exact_two_sided(int(nn), float(tt))
                      for nn, tt, tie in zip(n, t, ties)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(zz) else math.erfc(abs(zz) / math.sqrt(2.0)) for zz in z], dtype="float64")


def with_p_value(w: DataFrame, method: str = "normal") -> DataFrame:
    """Two-sided p of the result rows (neither engine has erf, so this is a
    helper on one row per group).  ``normal``: normal approximation with tie
    correction, at every n.  ``exact``: null distribution of the rank sum, at
    every n (cubic in n); NULL where differences tie, as ranks are not 1..n then."""
    if method == "normal":
        return w.withColumn("p_value", _normal_p(F.col("z")))
    if method == "exact":
        return w.withColumn("p_value", _exact_p(F.col("n"), F.col("t_stat"), F.col("tie_term")))
    raise ValueError(f"unknown method {method!r}")


UNIFORM_BITS = 32  # precision of ``uniform_from_md5``


def poisson1_cdf(bits: int = UNIFORM_BITS) -> list[float]:
    """Poisson(1) cumulative probabilities from 0 up, as far as a uniform number
    of ``bits`` bits can reach, so no draw is cut off."""
    out, term, total = [], math.exp(-1), 0.0
    while not out or total <= 1.0 - 2.0 ** -bits:
        total += term
        out.append(total)
        term /= len(out)
    return out


def uniform_from_md5(*parts) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of ``md5(parts joined by |)``."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / float(1 << UNIFORM_BITS)


def poisson_weight(u: Column) -> Column:
    """Inverse cumulative draw: how many of the probabilities ``u`` has passed."""
    return sum(((u >= F.lit(c)).cast("int") for c in poisson1_cdf()), F.lit(0))


BOOTSTRAP_CELLS = 1 << 20  # sums a task holds before it hands them on


def poisson_weights(seed, example, b: int) -> np.ndarray:
    """Weights of one example in replicates 1..b: ``poisson_weight(uniform_from_md5(seed,
    example, replicate))`` in one array (a null example is left out of the text, as there)."""
    head = hashlib.md5("|".join([str(seed)] + ([] if example is None else [str(example)]) + [""]).encode())
    heads = bytearray()
    for k in range(1, b + 1):
        h = head.copy()
        h.update(str(k).encode())
        heads += h.digest()[:4]
    u = np.frombuffer(bytes(heads), dtype=">u4") / float(1 << UNIFORM_BITS)
    return np.searchsorted(np.array(poisson1_cdf()), u, side="right")


def _bootstrap_sums(seed: int, b: int, keys: int, metrics: int, schema: pa.Schema, cells: int):
    """Weighted sums per key and replicate of one task's rows (columns: keys, example,
    metrics).  They are handed on whenever ``cells`` of them are held."""
    def handed(sums):
        kept = list(sums)
        cols = [pa.array([k[i] for k in kept for _ in range(b)], schema.field(i).type) for i in range(keys)]
        cols.append(pa.array(np.tile(np.arange(1, b + 1, dtype=np.int32), len(kept))))
        block = np.concatenate([sums[k] for k in kept], axis=1)
        return pa.RecordBatch.from_arrays(cols + [pa.array(x) for x in block], schema=schema)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                key, values = row[:keys], row[keys + 1:]
                w = poisson_weights(seed, row[keys], b)
                if key not in sums:
                    if sums and (len(sums) + 1) * b * 2 * metrics > cells:
                        yield handed(sums)
                        sums = {}
                    sums[key] = np.zeros((2 * metrics, b))
                for i, v in enumerate(values):
                    if v is not None:
                        sums[key][2 * i] += w * v
                        sums[key][2 * i + 1] += w
        if sums:
            yield handed(sums)

    return run


def bootstrap_ci(scores: DataFrame, keys, ex_key: str, metrics, b: int = 1000, seed: int = 13,
                 lo: float = 0.025, hi: float = 0.975, cells: int = BOOTSTRAP_CELLS) -> DataFrame:
    """Poisson bootstrap confidence interval of the mean of each metric per
    group.  Weights come from an md5 of ``(seed, example, replicate)``, so the
    result does not depend on partitioning and can be reproduced in SQL.

    No row is multiplied: every task adds the weight array of a row to the sums of its
    group and hands on one row per group and replicate, whatever the number of examples.
    A null score counts in neither sum; a replicate of weight 0 is left out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    kinds = T.StructType([T.StructField(f"k{i}", scores.schema[k].dataType) for i, k in enumerate(keys)]
                         + [T.StructField("b", T.IntegerType())]
                         + [T.StructField(f"{c}{i}", T.DoubleType()) for i in range(len(metrics)) for c in ("s", "w")])
    src = scores.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(ex_key).cast("string").alias("ex"),
                        *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])
    fold = _bootstrap_sums(seed, b, len(keys), len(metrics), to_arrow_schema(kinds), cells)
    part = src.mapInArrow(fold, kinds)
    ks = [f"k{i}" for i in range(len(keys))]
    means = part.groupBy(*ks, "b").agg(
        *[F.try_divide(F.sum(f"s{i}"), F.sum(f"w{i}")).alias(f"m{i}") for i in range(len(metrics))])
    out = means.groupBy(*ks).agg(
        *[F.percentile(F.col(f"m{i}"), F.array(F.lit(lo), F.lit(hi))).alias(f"c{i}") for i in range(len(metrics))])
    point = src.groupBy(*ks).agg(*[F.avg(f"m{i}").alias(f"p{i}") for i in range(len(metrics))])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ks]
    both = out.alias("a").join(point.alias("b"), reduce(lambda x, y: x & y, same))
    cols = [F.col(f"a.k{i}").alias(k) for i, k in enumerate(keys)]
    for i, m in enumerate(metrics):
        cols += [F.col(f"p{i}").alias(m), F.col(f"c{i}")[0].alias(f"{m}_cb"), F.col(f"c{i}")[1].alias(f"{m}_ce")]
    return both.select(*cols)


def finite_profile(df: DataFrame, vec: str) -> Column:
    """``all_finite`` / ``all_nonfinite`` / ``some_nonfinite`` for an array column."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vec)
    return (F.when(F.forall(v, lambda x: ~bad(x)), F.lit("all_finite"))
            .when(F.forall(v, bad), F.lit("all_nonfinite"))
            .otherwise(F.lit("some_nonfinite")))


def distinct_count(col, approx: bool = False, rsd: float = 0.01) -> Column:
    """Number of distinct values; ``approx`` switches to HyperLogLog++
    (``approx_count_distinct``, relative error ``rsd``) for very large sets,
    where the exact count shuffles every distinct value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.approx_count_distinct(c, rsd) if approx else F.countDistinct(c)
