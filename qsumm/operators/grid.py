"""Comparison grid (A11, K6, U2): every metric of every (task, summary type,
system) cell and of the totals over them, from one pass over the examples.

A cell is kept as sums (scores, their counts, BLEU counters), which add up: the
examples are aggregated once into their finest cells, and the totals come from
those few rows, so the examples are never expanded once per grouping set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsumm.operators.bleu import bleu_from_counts

ALL = "all"


def comparison_grid(scored: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], scores: dict[str, str],
                    bleu: str | None = "bleu", max_n: int = 4, digits: int = 6) -> DataFrame:
    """One row per cell of every grouping set of ``sets`` (lists of ``dims``).

    ``scores`` maps result names to columns of ``scored``; a cell's result is the mean
    over its examples that have a score (null if none has).  With ``bleu`` (prefix of
    the counters of ``with_bleu_counts``) corpus BLEU follows as ``bleu``.  ``n`` counts
    examples.  A dimension that a set leaves out reads ``all``; null dimension values
    are cells of their own and stay null; without examples there are no cells."""
    parts = [F.count(F.lit(1)).alias("n")]
    names = ["n"]
    for i, column in enumerate(scores.values()):
        parts += [F.sum(column).alias(f"s{i}"), F.count(column).alias(f"c{i}")]
        names += [f"s{i}", f"c{i}"]
    if bleu:
        counters = [f"{bleu}_{n}_{k}" for n in range(1, max_n + 1) for k in ("num", "den")] + [f"{bleu}_c", f"{bleu}_r"]
        parts += [F.sum(c).alias(c) for c in counters]
        names += counters
    cells = scored.groupBy(*dims).agg(*parts)
    sums = (cells.groupingSets([[F.col(d) for d in s] for s in sets], *dims)
            .agg(*[F.sum(c).alias(c) for c in names], *[F.grouping(d).alias(f"g_{d}") for d in dims]))
    out = [F.when(F.col(f"g_{d}") == 1, F.lit(ALL)).otherwise(F.col(d)).alias(d) for d in dims] + [F.col("n")]
    out += [F.round(F.col(f"s{i}") / F.nullif(F.col(f"c{i}"), F.lit(0)), digits).alias(name)
            for i, name in enumerate(scores)]
    if bleu:
        value = bleu_from_counts([F.col(f"{bleu}_{n}_num") for n in range(1, max_n + 1)],
                                 [F.col(f"{bleu}_{n}_den") for n in range(1, max_n + 1)], F.col(f"{bleu}_c"), F.col(f"{bleu}_r"))
        out.append(F.round(value, digits).alias("bleu"))
    return sums.select(*out)
