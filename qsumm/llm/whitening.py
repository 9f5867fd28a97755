"""Whitening of embeddings by Jacobi-Davidson on the matrix-free covariance.

Vectors become integers (``floor(scale * c) + shift``), so sums and deviations
are exact.  The covariance is never formed: ``products`` is one pass over the
vectors that gives V @ P for a block P of a few directions, summed inside every
task before it is shuffled.  The leading eigenvectors come from a block
Jacobi-Davidson iteration on the driver, whose matrices have the vectors'
dimension times at most ``MAX_BASIS`` columns:

1. Rayleigh-Ritz on the search space (its products are kept, no pass needed);
2. leading pairs whose residual reached double precision are locked;
3. for every open pair the projected correction equation
   (I - QQ')(V - theta I)(I - QQ') t = -r is solved by ``INNER`` MINRES steps,
   all pairs in lockstep, so that a step is one pass;
4. the corrections enter the space (one pass); a full space is restarted from
   its best Ritz vectors.

Defined results: vectors that are null, empty or hold a null or non-finite
entry take no part, nor do vectors of another than the commonest length (the
longer on ties); repeated rows count as often as they occur; entries beyond
2**53 / scale are taken as that bound; a deviation beyond 64 bits is null;
components of variance zero (at most n - 1 have one) have no whitened values
and are left out, so one single vector and an empty table give no rows; null
ids are carried; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 1024  # vectors of a staged block
BOUND = 1 << 53  # integers of a double
INNER = 8  # MINRES steps of a correction
MAX_BASIS = 40
MAX_OUTER = 200


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """The vectors that take part, staged as blocks (their ids, their integers row
    by row in one buffer), and their dimension."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = common["d"] if common else 0

    def entry(c):
        return F.greatest(F.least(F.floor(F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(-2.0 * BOUND)),
                                                  F.lit(2.0 * BOUND))) + F.lit(SHIFT), F.lit(BOUND)), F.lit(-BOUND))

    x = fine.where(F.size("v") == d).select("id", F.transform("v", entry).alias("x"))

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.array([np.asarray(part.column("x").flatten()).astype("<i8").tobytes()])], ["ids", "x"])

    id_type = dict(vectors.dtypes)[id_col]
    return rows.stage(x.mapInArrow(pack, f"ids array<{id_type}>, x binary"), "whitening-x"), d


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for block in batch.column("x"):
        yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d)


def _summed(x: DataFrame, d: int, width: int, block) -> np.ndarray:
    """Sum over all vectors of ``block(integer rows) -> width`` doubles: one row
    per entry and task, added by Spark."""
    def add(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(width)
        for batch in batches:
            for m in _matrices(batch, d):
                total += block(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "s"])

    out = np.zeros(width)
    for r in x.select("x").mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]  # ``width`` rows whatever the input
    return out


def sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def add(batches):
        n, total = 0, [0] * d
        for batch in batches:
            for m in _matrices(batch, d):
                n += len(m)
                for lo in range(0, len(m), 512):  # 512 entries of at most 2**53 stay inside 64 bits
                    total = [a + b for a, b in zip(total, m[lo:lo + 512].sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in (n, *total)])],
                                         ["i", "s"])

    got = dict.fromkeys(range(-1, d), 0)
    for r in (x.select("x").mapInArrow(add, "i int, s string")
              .groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()):
        got[r["i"]] = int(r["s"])
    return got[-1], [got[i] for i in range(d)]


def centred(m: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n without rounding x or S/n first: the integer part of the mean goes exactly."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    part = np.array([(s % n) / n for s in total])
    return (m - whole).astype(np.float64) - part


def deviations(m: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2 per row, exact; null beyond 64 bits."""
    near = centred(m, n, total) * n
    if (near * near).sum(axis=1).max(initial=0.0) < 2.0**62 and n < 2**31:
        whole = np.array([s // n for s in total], dtype=np.int64)
        rest = np.array([s % n for s in total], dtype=np.int64)
        exact = n * (m - whole) - rest
        return (exact * exact).sum(axis=1).tolist()
    out = []
    for r in m.tolist():
        v = sum((n * a - s) ** 2 for a, s in zip(r, total))
        out.append(v if v < 1 << 63 else None)
    return out


class Covariance:
    """V of the integer vectors as an operator; counts its passes."""

    def __init__(self, x: DataFrame, d: int, n: int, total: list[int]):
        self.x, self.d, self.n, self.total, self.passes = x, d, n, total, 0

    def trace(self) -> float:
        n, total = self.n, self.total
        return float(_summed(self.x, self.d, 1, lambda m: np.square(centred(m, n, total)).sum())[0]) / n

    def __matmul__(self, p: np.ndarray) -> np.ndarray:
        """V @ p for a block p (dimension x m) in one pass."""
        self.passes += 1
        n, total = self.n, self.total

        def block(m):
            c = centred(m, n, total)
            return (c.T @ (c @ p)).ravel()

        return _summed(self.x, self.d, p.size, block).reshape(p.shape) / n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning ``block`` outside ``against``; directions that vanish go."""
    kept: list[np.ndarray] = []
    for v in block.T:
        size = np.linalg.norm(v)
        if not size > 0 or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            v = v - against @ (against.T @ v)
            for q in kept:
                v = v - q * (q @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.zeros((block.shape[0], 0))


def minres_block(product, shifts: np.ndarray, q: np.ndarray, rhs: np.ndarray, steps: int, rtol: float = 1e-3) -> np.ndarray:
    """Columns t_i of (I - qq')(V - shifts_i I)(I - qq') t_i = rhs_i by MINRES, in
    lockstep: every step is one ``product`` of a block.  Columns that are solved
    to ``rtol`` leave the block."""
    def project(b):
        b = b - q @ (q.T @ b)
        return b - q @ (q.T @ b)

    out = np.zeros_like(rhs)
    r = project(rhs)
    beta = np.linalg.norm(r, axis=0)
    goal = beta * rtol
    on = np.flatnonzero(beta > 0)
    d = rhs.shape[0]
    k = len(on)
    v_old, v = np.zeros((d, k)), r[:, on] / beta[on]
    w_old, w = np.zeros((d, k)), np.zeros((d, k))
    eta, b = beta[on].copy(), beta[on].copy()
    b[:] = 0.0
    c_old, c = np.ones(k), np.ones(k)
    s_old, s = np.zeros(k), np.zeros(k)
    for _ in range(steps):
        if not len(on):
            break
        av = project(product(v) - v * shifts[on])
        alpha = (v * av).sum(axis=0)
        nxt = av - v * alpha - v_old * b
        b_next = np.linalg.norm(nxt, axis=0)
        delta = c * alpha - c_old * s * b
        rho1 = np.sqrt(delta * delta + b_next * b_next)
        rho2 = s * alpha + c_old * c * b
        rho3 = s_old * b
        rho1 = np.where(rho1 > 0, rho1, np.finfo(float).tiny)
        c_new, s_new = delta / rho1, b_next / rho1
        w_new = (v - w_old * rho3 - w * rho2) / rho1
        out[:, on] += w_new * (c_new * eta)
        eta = -s_new * eta
        go = (np.abs(eta) > goal[on]) & (b_next > 1e-14 * np.abs(alpha))
        v_old, v = v[:, go], nxt[:, go] / b_next[go]
        w_old, w = w[:, go], w_new[:, go]
        b, eta = b_next[go], eta[go]
        c_old, c, s_old, s = c[go], c_new[go], s[go], s_new[go]
        on = on[go]
    return project(out)


def jacobi_davidson(a, d: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the operator ``a`` (``a @ block``), falling,
    and their unit eigenvectors as columns.  Pairs are locked when their residual
    is at the rounding of a product, 4 * dimension * epsilon * largest value."""
    k = min(k, d)
    most = min(d, max(MAX_BASIS, 3 * k))
    basis = _orthonormal(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, min(d, 2 * k))), np.zeros((d, 0)))
    image = a @ basis
    last, stuck = np.inf, 0
    for _ in range(MAX_OUTER):
        h = basis.T @ image
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        x, ax = basis @ u[:, :k], image @ u[:, :k]
        r = ax - x * theta[:k]
        size = np.linalg.norm(r, axis=0)
        rounding = 4 * d * np.finfo(float).eps * max(float(theta[0]), 0.0)
        open_ = np.flatnonzero(size > rounding)
        worst = float(size.max())
        stuck = stuck + 1 if worst > 0.5 * last else 0
        last = min(last, worst)
        # A product's own rounding may lie above the bound: then residuals stop falling near it.
        if not len(open_) or basis.shape[1] == d or (stuck >= 3 and worst <= 64 * rounding):
            x = x / np.linalg.norm(x, axis=0)
            return theta[:k], x
        if basis.shape[1] + len(open_) > most:  # thick restart; locked pairs come first
            keep = min(2 * k, most - len(open_))
            basis, image = basis @ u[:, :keep], image @ u[:, :keep]
        t = minres_block(lambda b: a @ b, theta[open_], x, -r[:, open_], INNER)
        new = _orthonormal(t, basis)
        if not new.shape[1]:
            new = _orthonormal(r[:, open_], basis)
        if not new.shape[1]:
            raise ArithmeticError("the search space cannot grow although residuals are open")
        basis, image = np.hstack([basis, new]), np.hstack([image, a @ new])
    raise ArithmeticError(f"no convergence in {MAX_OUTER} steps")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error for
    every vector that takes part and every component of positive variance."""
    id_type = dict(vectors.dtypes)[id_col]
    schema = (f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    x, d = integers(vectors, id_col, vector_col)
    n, total = sums(x, d)
    v = Covariance(x, d, n, total)
    trace = v.trace() if n else 0.0
    if not trace > 0:
        return vectors.sparkSession.createDataFrame([], schema)
    e, q = jacobi_davidson(v, d, components)
    have = e > d * np.finfo(float).eps * e[0] * 8
    e, q = e[have], q[:, have]
    k = len(e)
    scaled = q / np.sqrt(e)

    # Covariance of the whitened values: their mean first, then centred products.
    mean = _summed(x, d, k, lambda m: (centred(m, n, total) @ scaled).sum(axis=0)) / n

    def spread(m):
        w = centred(m, n, total) @ scaled - mean
        return (w.T @ w).ravel()

    error = float(np.abs(_summed(x, d, k * k, spread).reshape(k, k) / n - np.eye(k)).max())
    explained = e / trace

    def project(batches):
        for batch in batches:
            for names, m in zip(batch.column("ids"), _matrices(batch, d)):
                w = centred(m, n, total) @ scaled
                at = np.repeat(np.arange(len(m)), k)
                ids = names.values.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                     pa.array(np.full(len(at), n, np.int64)),
                     pa.array(deviations(m, n, total), pa.int64()).take(pa.array(at)), pa.array(w.ravel()),
                     pa.array(np.tile(explained, len(m))), pa.array(np.full(len(at), error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)
