"""Logistic regression by Newton steps over DataFrame aggregates (M2).

A step is one aggregate: the gradient and the upper triangle of the Hessian over
a fixed list of features, partially summed in every task, one row out.  Only
that row reaches the driver, which solves a system as large as the feature
list.  The ridge term (on every coefficient, the intercept included) keeps it
solvable and makes the optimum unique, so the result does not depend on row
order beyond rounding.  ``probability`` turns coefficients into a column
expression: scoring is a projection.

Rows with a null label or feature take no part; without any row all
coefficients stay 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsumm.operators.stats import average_ranks
from qsumm.session import cut_lineage

RIDGE = 1.0
STEPS = 12


def probability(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    """P(label = 1) of a row; the first coefficient is the intercept."""
    z = F.lit(float(coefficients[0]))
    for c, name in zip(coefficients[1:], features, strict=True):
        z = z + F.lit(float(c)) * F.col(name)
    return 1.0 / (1.0 + F.exp(-z))


def newton_step(train: DataFrame, label: str, features: Sequence[str], at: np.ndarray, ridge: float) -> np.ndarray:
    """The change of the coefficients, from one pass over ``train``."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    k = len(x)
    p = train.withColumn("__p", probability(at, features)).withColumn("__w", F.col("__p") * (1 - F.col("__p")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = p.agg(*[F.sum((F.col(label) - F.col("__p")) * x[i]).alias(f"g{i}") for i in range(k)],
                *[F.sum(F.col("__w") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
    gradient = np.array([got[f"g{i}"] or 0.0 for i in range(k)]) - ridge * at
    hessian = np.zeros((k, k))
    for i, j in pairs:
        hessian[i, j] = hessian[j, i] = (got[f"h{i}_{j}"] or 0.0) + (ridge if i == j else 0.0)
    return np.linalg.solve(hessian, gradient)


def fit_logistic(df: DataFrame, label: str, features: Sequence[str], ridge: float = RIDGE, steps: int = STEPS) -> list[float]:
    """Intercept and coefficients after ``steps`` Newton steps from zero."""
    train = cut_lineage(df.select(F.col(label).cast("double").alias(label),
                                  *[F.col(f).cast("double").alias(f) for f in features]).dropna())
    at = np.zeros(len(features) + 1)
    for _ in range(steps):
        at = at + newton_step(train, label, features, at, ridge)
    return at.tolist()


def area_under_curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``(n, n_positive, auc)``: the share of (positive, negative) pairs in
    the right order, ties half, from average ranks over distinct scores."""
    s = scored.select(F.col(score).alias("__s"), F.col(label).cast("long").alias("__y"))
    ranks = average_ranks(s, "__s").select("__s", "avg_rank")
    by = s.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__pos"))
    total = by.join(ranks, "__s").agg(F.sum("__n").alias("n"), F.sum("__pos").alias("n_positive"),
                                      F.sum(F.col("avg_rank") * F.col("__pos")).alias("__r"))
    pos, neg = F.col("n_positive"), F.col("n") - F.col("n_positive")
    return total.select("n", "n_positive", F.when((pos > 0) & (neg > 0), (F.col("__r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))
