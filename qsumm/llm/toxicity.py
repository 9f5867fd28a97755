"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is the logistic of
a sum of word weights, a document's is the noisy-or of its sentences,
``1 - prod(1 - p)``.  Only documents carry labels; the weights are trained by
gradient descent on the document log-likelihood, so the model itself finds the
sentences that explain a label, and ``locate`` returns them.

Fitting uses at most ``PER_CLASS`` labelled documents of each class (smallest
hash of the id; the bound is the only sampling here).  Their whole texts become
(sentence, word cell) pairs inside the tasks.  Word cells enter the model when
their document counts differ between the classes by more than ``MIN_Z``
standard errors, at most the ``MAX_FEATURES`` strongest; both are parameters of
``fit``.  Every document is scored over its whole text.

Defined results: null and empty texts have no sentence and get the score of an
empty bag, 0; with labels of one class only (or none) the score is that class
for all (0 without labels); null labels and labels of absent documents are not
learned from; a document labelled twice counts as toxic if any label says so;
repeated rows get equal scores; of texts with one id the smallest is learned
from; other columns are returned by ``score`` and have no part in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rows, scan

CELLS = 1 << 20
PER_CLASS = 4000
MIN_Z = 5.0
MAX_FEATURES = 4096  # strongest cells kept; bounds the model
RESULTS = T.StructType([T.StructField("toxicity", T.DoubleType())])

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences (runs between sentence ends, documents never joined)."""
    return scan.runs(~_STOP[buf], offsets)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, start) of every letter run; A-Z and a-z count as equal."""
    starts, ends, _ = scan.runs(_LETTER[buf], offsets)
    h = scan.word_hashes(scan.LOWER[buf], starts, ends)
    return (h & np.uint64(CELLS - 1)).astype(np.int64), starts


class Model:
    """``cells`` (sorted), their ``weights`` and the sentence ``bias``."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, bias: float, constant: float | None = None):
        self.cells, self.weights, self.bias, self.constant = cells, weights, bias, constant

    def sentence_scores(self, buf: np.ndarray, offsets: np.ndarray):
        """(probability, start, end, first sentence of each document)."""
        s, e, first = sentences(buf, offsets)
        cell, at = words_of(buf, offsets)
        logit = np.full(len(s), self.bias)
        if len(self.cells) and len(cell):
            where = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            hit = self.cells[where] == cell
            sent = np.searchsorted(s, at[hit], "right") - 1
            np.add.at(logit, sent, self.weights[where[hit]])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))), s, e, first

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        p, _, _, first = self.sentence_scores(buf, offsets)
        run = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
        return np.clip(-np.expm1(run[first[1:]] - run[first[:-1]]), 0.0, 1.0)


def train(bags: list[tuple[int, np.ndarray, np.ndarray, int]], steps: int = 400, l2: float = 2e-3,
          min_z: float = MIN_Z, max_features: int = MAX_FEATURES) -> Model:
    """``bags``: (label, cell of each word, sentence of each word, sentences)."""
    y = np.array([b[0] for b in bags], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(y[0]) if len(y) else 0.0)
    # Document counts per cell and class.
    seen = [np.unique(b[1]) for b in bags]
    cells = np.concatenate(seen)
    label = np.repeat(y, [len(s) for s in seen])
    distinct, inverse = np.unique(cells, return_inverse=True)
    pos = np.bincount(inverse, weights=label, minlength=len(distinct))
    neg = np.bincount(inverse, minlength=len(distinct)) - pos
    n1, n0 = y.sum(), len(y) - y.sum()
    p = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    strong = np.flatnonzero(np.abs(z) >= min_z)
    strong = np.sort(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:max_features]])
    chosen = distinct[strong]
    # Flat training set: one row per (sentence, chosen word).
    sent_doc = np.repeat(np.arange(len(bags)), [b[3] for b in bags])
    base = np.concatenate([[0], np.cumsum([b[3] for b in bags])])
    word_f, word_s = [], []
    for i, b in enumerate(bags):
        if len(chosen):
            at = np.minimum(np.searchsorted(chosen, b[1]), len(chosen) - 1)
            hit = chosen[at] == b[1]
            word_f.append(at[hit])
            word_s.append(b[2][hit] + base[i])
    word_f = np.concatenate(word_f) if word_f else np.zeros(0, np.int64)
    word_s = np.concatenate(word_s) if word_s else np.zeros(0, np.int64)
    w = np.log((pos[strong] + 0.5) / n1) - np.log((neg[strong] + 0.5) / n0)
    bias = -6.0
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        logit = bias + np.bincount(word_s, weights=w[word_f], minlength=len(sent_doc))
        ps = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        quiet = np.bincount(sent_doc, weights=np.log1p(-np.minimum(ps, 1 - 1e-9)), minlength=len(y))
        pd = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        # d(-loglik)/d(logit of sentence s) = ps * (1 - y / pd)
        g = ps * (weight * (1.0 - y / pd))[sent_doc]
        gw = np.bincount(word_f, weights=g[word_s], minlength=len(w)) + l2 * w / max(len(w), 1)
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w = w - 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Model(chosen, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = PER_CLASS, min_z: float = MIN_Z,
        max_features: int = MAX_FEATURES) -> Model:
    """Model from at most ``per_class`` labelled documents of each class."""
    one = (labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y"))
           .where("lid is not null and y is not null").groupBy("lid").agg(F.max("y").alias("y")))
    parts = [one.where(F.col("y") == v).orderBy(F.xxhash64("lid"), "lid").limit(per_class) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # A bounded side: at most 2 * per_class rows of two numbers.
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("lid"))
    # One text per id, so that repeats do not reach the driver.
    chosen = picked.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")

    def bags(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(1))
            y = batch.column(2).to_pylist()
            for lo, hi in scan.chunks(off):
                b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                s, _, first = sentences(b, o)
                cell, at = words_of(b, o)
                sent = np.searchsorted(s, at, "right") - 1
                doc = np.searchsorted(first, sent, "right") - 1
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                out = [(y[lo + i], int(first[i + 1] - first[i]),
                        cell[cut[i]:cut[i + 1]].astype("<i4").tobytes(),
                        (sent[cut[i]:cut[i + 1]] - first[i]).astype("<i4").tobytes()) for i in range(hi - lo)]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                     pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["id", "y", "n", "cells", "at"])

    id_type = dict(chosen.dtypes)["id"]
    got = chosen.mapInArrow(bags, f"id {id_type}, y int, n int, cells binary, at binary").orderBy("id").collect()
    return train([(r["y"], np.frombuffer(r["cells"], "<i4").astype(np.int64),
                   np.frombuffer(r["at"], "<i4").astype(np.int64), r["n"]) for r in got],
                 min_z=min_z, max_features=max_features)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns; its own column of this name is replaced) with
    ``toxicity`` in [0, 1]."""
    where = rows.place_of(docs, text_col, RESULTS)

    def run(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(where))
            for lo, hi in scan.chunks(off):
                p = model.scores(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield [*batch.slice(lo, hi - lo).columns, pa.array(p, pa.float64())]

    return rows.map_with_results(docs, run, RESULTS)


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           least: float = 0.5) -> DataFrame:
    """Offending sentences: id_col, byte offset ``start``, ``sentence`` and its ``score``."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(1))
            for lo, hi in scan.chunks(off):
                b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                if model.constant is not None:
                    continue
                p, s, e, first = model.sentence_scores(b, o)
                hit = np.flatnonzero(p >= least)
                if not len(hit):
                    continue
                doc = np.searchsorted(first, hit, "right") - 1
                raw = b.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + lo)), pa.array(s[hit] - o[doc]),
                     pa.array([raw[i:j].decode("utf-8") for i, j in zip(s[hit].tolist(), e[hit].tolist())], pa.string()),
                     pa.array(p[hit])], [id_col, "start", "sentence", "score"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, start long, sentence string, score double")
