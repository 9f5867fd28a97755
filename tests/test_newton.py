"""Newton logistic regression against numpy, its area under the curve against pair counting."""

import numpy as np

from qsumm.operators import newton as nw


def by_hand(x, y, ridge, steps):
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b, 1 / (1 + np.exp(-x @ b))


def test_coefficients_probabilities_and_area(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)).round(2)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    rows = [(int(c), float(a), float(b)) for c, (a, b) in zip(y, x)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0), (1, None, 2.0)], "y int, a double, b double").repartition(5)
    beta = nw.fit_logistic(df, "y", ["a", "b"])
    want, p = by_hand(x, y, nw.RIDGE, nw.STEPS)
    assert np.allclose(beta, want, rtol=1e-9)
    scored = df.dropna().select("y", nw.probability(beta, ["a", "b"]).alias("p"))
    assert np.allclose(sorted(r["p"] for r in scored.collect()), np.sort(p))
    coarse = scored.selectExpr("y", "round(p, 1) as p")  # many ties
    got = nw.area_under_curve(coarse, "p", "y").first()
    s = np.round(p, 1)
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got["n"] == 400 and got["n_positive"] == y.sum() and abs(got["auc"] - pairs / (len(pos) * len(neg))) < 1e-12


def test_separable_one_class_and_empty(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 1.0)] * 20, "y int, a double")
    beta = nw.fit_logistic(df, "y", ["a"])
    assert abs(beta[0]) < 1e-9 and 0 < beta[1] < 10  # the ridge bounds separable data
    ones = df.where("y = 1")
    assert nw.fit_logistic(ones, "y", ["a"])[1] > 0
    assert nw.area_under_curve(ones.selectExpr("y", "a as s"), "s", "y").first()["auc"] is None
    assert nw.fit_logistic(df.limit(0), "y", ["a"]) == [0.0, 0.0]
