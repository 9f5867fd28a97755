"""BLEU (A13 corpus level, A14 per example, over words or characters).

Per pair: clipped n-gram matches (counted in Arrow batches, linear in the
tokens) and the number of candidate n-grams (at least 1), n = 1..4, plus both
lengths; all integers, computed in-row.  Corpus
BLEU sums those counters per group and finishes with one-row arithmetic:
``BP * exp(mean(log p_n))``, 0 when any n has no match, ``BP = exp(1 - r/c)``
when the candidate side is not longer, 0 when it is empty.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def characters(col) -> Column:
    """Every character (code point) of a string, in order."""
    return F.regexp_extract_all(_c(col), F.lit(r"(?s)."), F.lit(0))


def clipped_counts(h, r, max_n: int, sep: str) -> list[int]:
    """Clipped n-gram matches of two token lists for n = 1..max_n, in time linear in the tokens."""
    out = []
    for n in range(1, max_n + 1):
        a, b = (Counter(map(sep.join, zip(*(t[i:] for i in range(n))))) for t in (h, r))
        out.append((a & b).total())
    return out


def _counts_udf(max_n: int, sep: str):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else clipped_counts(a.tolist(), b.tolist(), max_n, sep)
                          for a, b in zip(h, r)], dtype=object)
    return counts


def with_bleu_counts(df: DataFrame, hyp_tokens, ref_tokens, max_n: int = 4, unit: str = "word",
                     prefix: str = "bleu") -> DataFrame:
    """Adds ``{prefix}_{n}_num``, ``{prefix}_{n}_den``, ``{prefix}_c`` (candidate
    length) and ``{prefix}_r`` (reference length)."""
    sep = "\u0001" if unit == "word" else ""
    h, r = _c(hyp_tokens), _c(ref_tokens)
    out = df.withColumn(f"__{prefix}_h", h).withColumn(f"__{prefix}_r", r)
    hh, rr = F.col(f"__{prefix}_h"), F.col(f"__{prefix}_r")
    out = out.withColumn(f"__{prefix}_nums", _counts_udf(max_n, sep)(hh, rr))
    for n in range(1, max_n + 1):
        out = (out.withColumn(f"{prefix}_{n}_num", F.get(f"__{prefix}_nums", F.lit(n - 1)))
                  .withColumn(f"{prefix}_{n}_den", F.greatest(F.size(hh) - F.lit(n - 1), F.lit(1)).cast("long")))
    out = out.withColumn(f"{prefix}_c", F.size(hh).cast("long")).withColumn(f"{prefix}_r", F.size(rr).cast("long"))
    return out.drop(f"__{prefix}_h", f"__{prefix}_r", f"__{prefix}_nums")


def bleu_from_counts(nums, dens, c: Column, r: Column) -> Column:
    any_zero = None
    log_sum = None
    for num, den in zip(nums, dens):
        z = num == 0
        any_zero = z if any_zero is None else (any_zero | z)
        term = F.log(num / den)
        log_sum = term if log_sum is None else log_sum + term
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    return F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(log_sum / len(nums)))


def sentence_bleu(df: DataFrame, max_n: int = 4, prefix: str = "bleu", out: str = "bleu") -> DataFrame:
    """BLEU of each pair on its own (counters from ``with_bleu_counts``)."""
    nums = [F.col(f"{prefix}_{n}_num") for n in range(1, max_n + 1)]
    dens = [F.col(f"{prefix}_{n}_den") for n in range(1, max_n + 1)]
    return df.withColumn(out, bleu_from_counts(nums, dens, F.col(f"{prefix}_c"), F.col(f"{prefix}_r")))


def corpus_bleu(df: DataFrame, keys, max_n: int = 4, prefix: str = "bleu", digits: int = 6) -> DataFrame:
    """Corpus BLEU per group from summed counters."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    sums = [F.sum(f"{prefix}_{n}_{k}").alias(f"s{n}{k}") for n in range(1, max_n + 1) for k in ("num", "den")]
    agg = df.groupBy(*keys).agg(*sums, F.sum(f"{prefix}_c").alias("sc"), F.sum(f"{prefix}_r").alias("sr"))
    nums = [F.col(f"s{n}num") for n in range(1, max_n + 1)]
    dens = [F.col(f"s{n}den") for n in range(1, max_n + 1)]
    c, r = F.col("sc"), F.col("sr")
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    cols = [*keys, F.round(bleu_from_counts(nums, dens, c, r), digits).alias("bleu"),
            F.round(bp, digits).alias("brevity_penalty")]
    cols += [F.round(nums[i] / dens[i], digits).alias(f"p{i + 1}") for i in range(max_n)]
    return agg.select(*cols)
