"""ROUGE family.

Counts are integers computed in-row (no shuffle); ratios are taken last.
ROUGE-N overlap uses a JVM-only clipped multiset intersection; LCS runs in an
Arrow-batched pandas UDF with a bit-parallel kernel (one big-int step per
token of the longer side).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsumm.functions.text import ngrams, rouge_tokens


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ----------------------------------------------------------------------------
# LCS kernel (per-row helper)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    bit = 1
    for tok in b:
        masks[tok] = masks.get(tok, 0) | bit
        bit <<= 1
    full = bit - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def lcs_length_dp(a, b) -> int:
    """Plain dynamic program, used by tests as a cross-check."""
    if not len(a) or not len(b):
        return 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcs_each_udf(many: pd.Series, b: pd.Series) -> pd.Series:
    """LCS of every token list in ``many`` against ``b``."""
    out = []
    for lists, y in zip(many, b):
        if lists is None:
            out.append(None)
        else:
            out.append([lcs_length(x, y) for x in lists])
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def lcs_best_udf(a: pd.Series, many: pd.Series) -> pd.Series:
    """Best LCS of ``a`` against any token list in ``many`` (0 when a is null)."""
    out = []
    for x, lists in zip(a, many):
        if x is None or lists is None:
            out.append(0)
        else:
            out.append(max((lcs_length(x, y) for y in lists), default=0))
    return pd.Series(out, dtype="int32")


# ----------------------------------------------------------------------------
# Clipped n-gram overlap, JVM side


def _occurrence_tagged(arr: Column) -> Column:
    """Each element suffixed with its occurrence number among equal elements.

    The sorted array is bound once through a one-element ``transform`` so the
    inner lambda does not sort again for every element."""
    return F.element_at(F.transform(F.array(F.array_sort(arr)), lambda s: F.transform(s, lambda x, i: F.concat(
        x, F.lit("\u0001"), (i - F.array_position(s, x) + 1).cast("string")))), 1)


def keep_shared(a, b) -> Column:
    """Tokens of ``a`` that occur in ``b``, in order.  LCS(a, b) equals
    LCS(keep_shared(a, b), b): a token absent from ``b`` is in no common
    subsequence, so the LCS kernel can be fed the shorter arrays."""
    bb = _c(b)
    return F.filter(_c(a), lambda t: F.array_contains(bb, t))


LONG = 512  # items from which the overlap is counted in a sorted pass


def _merged_overlap(h: Column, r: Column) -> Column:
    """Clipped overlap from one walk over the sorted items of both sides: every item of
    ``r`` takes one equal item of ``h`` that is left."""
    side = lambda a, k: F.transform(a, lambda x: F.struct(x.alias("g"), F.lit(k).alias("k")))
    none = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("hits"))

    def step(acc, z):
        left = F.when(z["g"].eqNullSafe(acc["g"]), acc["left"]).otherwise(F.lit(0).cast("long"))
        hit = F.when((z["k"] == 1) & (left > 0), F.lit(1)).otherwise(F.lit(0))
        kept = F.when(z["k"] == 0, left + 1).otherwise(left - hit)
        return F.struct(z["g"].alias("g"), kept.alias("left"), (acc["hits"] + hit).alias("hits"))

    return F.aggregate(F.sort_array(F.concat(side(h, 0), side(r, 1))), none, step, lambda acc: acc["hits"])


def clipped_overlap(h, r) -> Column:
    """sum over distinct items g of min(count_h(g), count_r(g)).  Tagging is quadratic in
    the items, so long texts are sorted and walked once instead."""
    h, r = _c(h), _c(r)
    tagged = F.size(F.array_intersect(_occurrence_tagged(h), _occurrence_tagged(r))).cast("long")
    return F.when(F.greatest(F.size(h), F.size(r)) > LONG, _merged_overlap(h, r)).otherwise(tagged)


def ngram_count(tokens, n: int) -> Column:
    return F.greatest(F.size(_c(tokens)) - F.lit(n) + F.lit(1), F.lit(0)).cast("long")


def prf(overlap: Column, hyp_count: Column, ref_count: Column, alpha: float = 0.5):
    """(precision, recall, f) with the zero conventions of the metric."""
    p = F.when(hyp_count > 0, overlap / hyp_count).otherwise(F.lit(0.0))
    r = F.when(ref_count > 0, overlap / ref_count).otherwise(F.lit(0.0))
    f = F.when((p == 0) | (r == 0), F.lit(0.0)).otherwise(p * r / ((1 - alpha) * p + alpha * r))
    return p, r, f


def with_rouge(df: DataFrame, hyp: str, ref: str, max_n: int = 3, alpha: float = 1.0,
               lcs: bool = True, prefix: str = "rouge") -> DataFrame:
    """Per-pair ROUGE-1..max_n and ROUGE-L.

    Adds integer counters ``{prefix}_{n}_overlap/_hyp/_ref`` and the ratios
    ``{prefix}_{n}_p/_r/_f``; ``n`` is ``1..max_n`` and ``l``.
    """
    ht, rt = f"__{prefix}_ht", f"__{prefix}_rt"
    out = df.withColumn(ht, rouge_tokens(hyp)).withColumn(rt, rouge_tokens(ref))
    for n in range(1, max_n + 1):
        hg = ngrams(ht, n) if n > 1 else F.col(ht)
        rg = ngrams(rt, n) if n > 1 else F.col(rt)
        out = (out.withColumn(f"{prefix}_{n}_overlap", clipped_overlap(hg, rg))
               .withColumn(f"{prefix}_{n}_hyp", ngram_count(ht, n))
               .withColumn(f"{prefix}_{n}_ref", ngram_count(rt, n)))
    if lcs:
        out = (out.withColumn(f"{prefix}_l_overlap", lcs_udf(keep_shared(F.col(ht), F.col(rt)),
                                                             keep_shared(F.col(rt), F.col(ht))).cast("long"))
               .withColumn(f"{prefix}_l_hyp", F.size(ht).cast("long"))
               .withColumn(f"{prefix}_l_ref", F.size(rt).cast("long")))
    names = [str(n) for n in range(1, max_n + 1)] + (["l"] if lcs else [])
    for n in names:
        p, r, f = prf(F.col(f"{prefix}_{n}_overlap"), F.col(f"{prefix}_{n}_hyp"),
                      F.col(f"{prefix}_{n}_ref"), alpha)
        out = out.withColumn(f"{prefix}_{n}_p", p).withColumn(f"{prefix}_{n}_r", r).withColumn(f"{prefix}_{n}_f", f)
    return out.drop(ht, rt)


def system_rouge(scored: DataFrame, keys=("system",), prefix: str = "rouge", max_n: int = 3,
                 measure: str = "r", digits: int = 6) -> DataFrame:
    """Mean per-example score by system (recall by default), one column per metric."""
    names = [str(n) for n in range(1, max_n + 1)] + ["l"]
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.round(F.avg(f"{prefix}_{n}_{measure}"), digits).alias(f"rouge_{n}") for n in names]
    return scored.groupBy(*keys).agg(*aggs)


def fast_rouge(df: DataFrame, hyp_tokens: str, ref_tokens: str, n: int = 2) -> DataFrame:
    """A12 per example: clipped n-gram overlap / number of gold n-grams (NULL when
    the gold side has fewer than n tokens)."""
    hg, rg = ngrams(hyp_tokens, n), ngrams(ref_tokens, n)
    gold = F.size(rg)
    return df.withColumn("fast_overlap", clipped_overlap(hg, rg)).withColumn(
        "fast_rouge", F.when(gold > 0, F.col("fast_overlap") / gold))


def sentence_labels(df: DataFrame, sents: str, ref_sents: str, threshold: float = 0.9,
                    out: str = "labels") -> DataFrame:
    """A16/A17 in-row (J5 without emitting pairs): for every article sentence the
    best ROUGE-L f (alpha 1: LCS over the sentence's own token count) against any
    summary sentence; label 1 when it is above ``threshold``.  Adds ``out``
    (labels) and ``best_scores``.

    Only sentences whose unigram bound can pass the threshold reach the LCS
    kernel; the bound is exact (LCS never exceeds the number of the sentence's
    tokens present in the summary), so pruned sentences score below it and
    their score is reported as the bound-capped value 0 only when the bound is 0.
    """
    ex = df.withColumn("__st", F.transform(sents, rouge_tokens)) \
           .withColumn("__rt", F.transform(ref_sents, rouge_tokens))
    ex = ex.withColumn("__rall", F.flatten(F.col("__rt")))
    bound = lambda t: F.size(F.filter(t, lambda x: F.array_contains(F.col("__rall"), x)))
    ex = ex.withColumn("__cand", F.transform("__st", lambda t: F.when(
        (F.size(t) > 0) & (bound(t) / F.size(t) > F.lit(threshold)), keep_shared(t, F.col("__rall")))))
    ex = ex.withColumn("__best", lcs_each_best(F.col("__cand"), F.col("__rt")))
    ex = ex.withColumn(out, F.transform(F.arrays_zip(F.col("__st").alias("t"), F.col("__best").alias("b")),
                                        lambda z: F.when(
                                            (F.size(z["t"]) > 0) & (z["b"] / F.size(z["t"]) > F.lit(threshold)),
                                            F.lit(1)).otherwise(F.lit(0))))
    return ex.drop("__st", "__rt", "__rall", "__cand", "__best")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcs_each_best(cands: pd.Series, refs: pd.Series) -> pd.Series:
    """For each candidate token list (null = pruned) the best LCS against any ref list."""
    out = []
    for cl, rl in zip(cands, refs):
        if cl is None:
            out.append(None)
            continue
        row = []
        for x in cl:
            if x is None:
                row.append(0)
            else:
                row.append(max((lcs_length(x, y) for y in rl), default=0) if rl is not None else 0)
        out.append(row)
    return pd.Series(out)


def sentence_best_scores(df: DataFrame, sents: str, ref_sents: str, out: str = "scores") -> DataFrame:
    """Best ROUGE-L f (alpha 1) of every article sentence against any summary
    sentence, as a double array parallel to ``sents`` (0 for empty sentences)."""
    ex = df.withColumn("__st", F.transform(sents, rouge_tokens)) \
           .withColumn("__rt", F.transform(ref_sents, rouge_tokens))
    ex = ex.withColumn("__rall", F.flatten(F.col("__rt")))
    ex = ex.withColumn("__best", lcs_each_best(F.transform("__st", lambda t: keep_shared(t, F.col("__rall"))),
                                               F.col("__rt")))
    ex = ex.withColumn(out, F.transform(F.arrays_zip(F.col("__st").alias("t"), F.col("__best").alias("b")),
                                        lambda z: F.when(F.size(z["t"]) > 0, z["b"] / F.size(z["t"]))
                                        .otherwise(F.lit(0.0))))
    return ex.drop("__st", "__rt", "__rall", "__best")


# ----------------------------------------------------------------------------
# Summary-level ROUGE-L (union LCS over sentences), per-row helper


def _next_row(v, matches, full):
    """One row of the bit-parallel table: a cleared bit is a column where the value rises."""
    u = v & matches
    return ((v + u) | (v - u)) & full


def _lcs_hits(ref, hyp, mask):
    """Mark in ``mask`` the positions of ``ref`` on one LCS with ``hyp`` (ties
    move up in ``ref`` first when backtracking).

    Going forward, every ``sqrt(len(ref))``-th bit row is kept; going back, the rows
    between two of them are made again.  ``2 sqrt(len(ref))`` rows of ``len(hyp)``
    bits are held, so lines of 10,000 tokens take a quarter of a megabyte."""
    m, n = len(ref), len(hyp)
    if m == 0 or n == 0:
        return
    where: dict = {}
    for j, tok in enumerate(hyp):
        where[tok] = where.get(tok, 0) | (1 << j)
    full = (1 << n) - 1
    step = math.isqrt(m - 1) + 1
    kept, v = [], full
    for i, tok in enumerate(ref):
        if i % step == 0:
            kept.append(v)
        v = _next_row(v, where.get(tok, 0), full)
    i, j = m, n
    low, rows = m, [v]  # rows[k] is row ``low + k`` of the table
    while i and j:
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            mask[i] = 1
            continue
        if i - 1 < low:
            low = (i - 1) // step * step
            rows = [kept[low // step]]
            for tok in ref[low:i]:
                rows.append(_next_row(rows[-1], where.get(tok, 0), full))
        left = (1 << j) - 1  # equal rises up to column j: equal values, so moving up keeps the length
        if (rows[i - 1 - low] & left).bit_count() == (rows[i - low] & left).bit_count():
            i -= 1
        else:
            j -= 1


def union_lcs_counts(hyp_sents, ref_sents):
    """(hypothesis tokens, reference tokens, clipped union-LCS hits) for
    sentence-split token lists."""
    from collections import Counter
    hyp_left = Counter(t for s in hyp_sents for t in s)
    ref_left = Counter(t for s in ref_sents for t in s)
    n_h, n_r = sum(hyp_left.values()), sum(ref_left.values())
    hits = 0
    for ref in ref_sents:
        mask = [0] * len(ref)
        for hyp in hyp_sents:
            _lcs_hits(ref, hyp, mask)
        for pos, v in enumerate(mask):
            if v:
                tok = ref[pos]
                if hyp_left[tok] > 0 and ref_left[tok] > 0:
                    hyp_left[tok] -= 1
                    ref_left[tok] -= 1
                    hits += 1
    return n_h, n_r, hits


_ULCS = T.StructType([T.StructField("hyp", T.LongType()), T.StructField("ref", T.LongType()),
                      T.StructField("overlap", T.LongType())])


@F.pandas_udf(_ULCS)
def union_lcs_udf(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [union_lcs_counts([list(s) for s in h] if h is not None else [],
                             [list(s) for s in r] if r is not None else []) for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=["hyp", "ref", "overlap"])


def with_rouge_lsum(df: DataFrame, hyp: str, ref: str, alpha: float = 1.0, prefix: str = "rouge_lsum") -> DataFrame:
    """Summary-level ROUGE-L: texts split into sentences at line breaks, union LCS
    of every reference sentence against all hypothesis sentences, hits clipped
    by unigram counts."""
    split = lambda c: F.transform(F.split(F.col(c), "\n", -1), rouge_tokens)
    out = df.withColumn("__u", union_lcs_udf(split(hyp), split(ref)))
    p, r, f = prf(F.col("__u.overlap"), F.col("__u.hyp"), F.col("__u.ref"), alpha)
    return out.withColumn(f"{prefix}_p", p).withColumn(f"{prefix}_r", r).withColumn(f"{prefix}_f", f).drop("__u")


def lcs_jvm(a, b) -> Column:
    """LCS length with built-in higher-order functions only (row-by-row dynamic
    program folded with ``aggregate``).  Interpreted and quadratic in copies:
    kept as the cross-check of the Arrow kernel, not for the hot path."""
    a, b = _c(a), _c(b)
    m = F.size(b)
    zeros = F.array_repeat(F.lit(0), m + 1)

    def step(row, x):
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.array(F.lit(0)),
            lambda acc, j: F.when(j > m, acc).otherwise(F.concat(acc, F.array(
                F.when(F.element_at(b, j) == x, F.element_at(row, j) + 1)
                .otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j)))))))

    return F.when((F.size(a) == 0) | (m == 0), F.lit(0)).otherwise(
        F.element_at(F.aggregate(a, zeros, step), m + 1))


def clipped_overlap_exploded(df: DataFrame, key: str, h: str, r: str, out: str = "overlap") -> DataFrame:
    """Linear-work twin of ``clipped_overlap``: this form explodes the
    items, counts them per ``(key, item)`` with map-side partial aggregation and
    sums ``least`` per key (two shuffles).  ``key`` must
    be unique per row."""
    sides = df.select(key, F.explode(F.concat(
        F.transform(F.col(h), lambda x: F.struct(x.alias("g"), F.lit(1).alias("ch"), F.lit(0).alias("cr"))),
        F.transform(F.col(r), lambda x: F.struct(x.alias("g"), F.lit(0).alias("ch"), F.lit(1).alias("cr"))))).alias("z"))
    per_item = sides.groupBy(key, "z.g").agg(F.sum("z.ch").alias("ch"), F.sum("z.cr").alias("cr"))
    per_key = per_item.groupBy(key).agg(F.sum(F.least("ch", "cr")).cast("long").alias(out))
    return df.join(per_key, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))
