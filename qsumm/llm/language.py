"""Hierarchical language identification.

Features are hashed character 1- to 3-grams of the lower-cased letters of the
whole text, as frequencies.  A linear classifier predicts the language family;
inside the family, one linear support vector machine for every pair of
languages votes.  Families come from ``FAMILIES`` and a tag outside the table
is a family of its own.

Fitting uses at most ``PER_LANGUAGE`` labelled documents of each language and
``SAMPLE_ROWS`` in all, or one per language if there are more languages (the
ones with the smallest hash of id and text in their language, and as many of
each language as it has or as the bound leaves; these bounds are the only
sampling here);
their whole texts are turned into features inside the tasks and only the
feature vectors reach the driver.  Every document is scored.

Defined results: null texts and texts without a letter are ``und`` with score
0; without labelled documents everything is ``und``; with one language all
others get it with score 1; rows with a null language are not learned from;
repeated rows get equal results and are learned from once; other columns are
returned by ``identify`` and have no part in it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rows, scan

DIMS = 1 << 12
GRAMS = (1, 2, 3)
PER_LANGUAGE = 400
SAMPLE_ROWS = 6400  # bound of the whole fitting sample
UNKNOWN = "und"
RESULTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

# Language families by tag (fixed values).
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY_OF = {tag: family for family, tags in FAMILIES.items() for tag in tags}

# Bytes that count as letters of a gram: ASCII letters (lower-cased) and every
# byte of a multi-byte character; anything else is a word break.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[0x80:] = True


def family(tag: str) -> str:
    return _FAMILY_OF.get(tag.lower().split("-")[0], tag)


def _cells(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature cell, document) of every gram of a flat chunk."""
    letter = _LETTER[buf]
    x = np.where(letter, scan.LOWER[buf], np.uint8(0x20)).astype(np.uint64)
    doc = scan.owner(offsets)
    cells, docs = [], []
    code = np.zeros(len(x), np.uint64)
    for g in GRAMS:
        # code[i] holds the g bytes from i on; grams inside or at the edge of a word, in one document
        n = len(x) - g + 1
        if n <= 0:
            break
        code = (code[:n] << np.uint64(8)) | x[g - 1:]
        ok = (doc[:n] == doc[g - 1:]) & letter[:n] if g < 3 else (doc[:n] == doc[g - 1:]) & letter[1:n + 1]
        at = np.flatnonzero(ok)
        h = scan.mix(code[at] + np.uint64(g << 40))
        cells.append((h & np.uint64(DIMS - 1)).astype(np.int64))
        docs.append(doc[at])
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(cells), np.concatenate(docs)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the gram frequencies, one row per document (unit length)."""
    docs = len(offsets) - 1
    cell, doc = _cells(buf, offsets)
    counts = np.bincount(doc * DIMS + cell, minlength=docs * DIMS).reshape(docs, DIMS)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def has_letter(texts: list) -> np.ndarray:
    return np.array([t is not None and any(c.isalpha() for c in t) for t in texts], dtype=bool)


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, balanced classes) by
    accelerated full-gradient descent; deterministic.  ``y`` in {-1, 1}."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    a = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    v = np.zeros(a.shape[1])
    ahead, step = v.copy(), 1.0 / (4.0 + l2)  # rows have length sqrt(2), weights sum to 1
    for t in range(epochs):
        short = np.maximum(0.0, 1.0 - y * (a @ ahead))
        grad = -2.0 * a.T @ (weight * short * y) + l2 * ahead
        new = ahead - step * grad
        ahead, v = new + (t / (t + 3.0)) * (new - v), new
    return v[:-1].astype(np.float32), float(v[-1])


class Model:
    """Family classifiers (one against the rest) and pairwise machines per family."""

    def __init__(self, x: np.ndarray, tags: np.ndarray):
        self.languages = sorted(set(tags))
        self.members: dict[str, list[str]] = {}
        for tag in self.languages:
            self.members.setdefault(family(tag), []).append(tag)
        self.families = sorted(self.members)
        of = np.array([family(t) for t in tags])
        self.rows: list[np.ndarray] = []
        self.bias: list[float] = []
        self.family_at: dict[str, int] = {}
        self.pair_at: dict[tuple[str, str], int] = {}
        if len(self.families) > 1:
            for f in self.families:
                self.family_at[f] = self._add(x, np.where(of == f, 1.0, -1.0))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                pick = (tags == a) | (tags == b)
                self.pair_at[a, b] = self._add(x[pick], np.where(tags[pick] == a, 1.0, -1.0))
        self.w = np.stack(self.rows, axis=1) if self.rows else np.zeros((DIMS, 0), np.float32)
        self.b = np.array(self.bias, np.float32)
        del self.rows, self.bias

    def _add(self, x, y) -> int:
        w, b = svm(x, y)
        self.rows.append(w)
        self.bias.append(b)
        return len(self.rows) - 1

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): score is the logistic of the smallest margin on the way."""
        n = len(x)
        m = x @ self.w + self.b if self.w.shape[1] else np.zeros((n, 0))
        margin = np.full(n, np.inf)
        chosen = np.zeros(n, np.int64)
        if self.family_at:
            f = m[:, [self.family_at[k] for k in self.families]]
            chosen = f.argmax(1)
            top = np.sort(f, axis=1)
            margin = (top[:, -1] - top[:, -2]) / 2
        out = np.empty(n, dtype=object)
        for i, name in enumerate(self.families):
            own = np.flatnonzero(chosen == i)
            tags = self.members[name]
            if not len(own):
                continue
            votes, strength = np.zeros((len(own), len(tags))), np.zeros((len(own), len(tags)))
            for (a, b), at in self.pair_at.items():
                if a in tags and b in tags:
                    s = m[own, at]
                    ia, ib = tags.index(a), tags.index(b)
                    votes[:, ia] += s >= 0
                    votes[:, ib] += s < 0
                    strength[:, ia] += np.clip(s, -1, 1)
                    strength[:, ib] -= np.clip(s, -1, 1)
            best = (votes * 1e3 + strength).argmax(1)
            out[own] = np.array(tags, dtype=object)[best]
            for j, tag in enumerate(tags):
                mine = own[best == j]
                for (a, b), at in self.pair_at.items():
                    if tag in (a, b):
                        s = m[mine, at] * (1 if tag == a else -1)
                        margin[mine] = np.minimum(margin[mine], s)
        with np.errstate(over="ignore"):
            score = 1.0 / (1.0 + np.exp(-3.0 * np.minimum(margin, 20.0)))
        return out, score


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from at most ``per_language`` documents of each language."""
    order = W.partitionBy("lang").orderBy("h")
    # The ranked rows carry ids only; Spark limits them before the shuffle.
    pool = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text is not null")
    # Repeats of a row share a rank and count once.
    picked = (pool.select("lang", "h").withColumn("r", F.dense_rank().over(order))
              .where(F.col("r") <= per_language).distinct())
    # By rank first: the bound takes from the languages with the most documents, never all of one.
    at_most = max(SAMPLE_ROWS, labelled.select(lang_col).distinct().count())
    picked = picked.orderBy("r", "h", "lang").limit(at_most).select("lang", "h")
    # Repeats go before the fetch: it holds one row per pick.
    sample = (pool.join(F.broadcast(picked), ["lang", "h"])
              .groupBy("lang", "h").agg(F.min("text").alias("text")))

    def vectors(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(1))
            for lo, hi in scan.chunks(off):
                x = features(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "h", "x"])

    got = (sample.select("lang", "text", "h").mapInArrow(vectors, "lang string, h long, x binary")
           .orderBy("lang", "h").collect())
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return Model(x, np.array([r["lang"] for r in got], dtype=object))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns; its own columns of these names are replaced) with
    ``lang_pred`` and ``lang_score``."""
    where = rows.place_of(docs, text_col, RESULTS)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = held.value
        for batch in batches:
            texts = batch.column(where)
            buf, off = scan.texts_of(texts)
            for lo, hi in scan.chunks(off, scan.CHUNK_BYTES // 2):
                tags, score = np.full(hi - lo, UNKNOWN, dtype=object), np.zeros(hi - lo)
                known = has_letter(texts.slice(lo, hi - lo).to_pylist())
                if m is not None and known.any():
                    x = features(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    t, s = m.predict(x)
                    tags[known], score[known] = t[known], s[known]
                part = batch.slice(lo, hi - lo)
                yield [*part.columns, pa.array(tags.tolist(), pa.string()), pa.array(score, pa.float64())]

    return rows.map_with_results(docs, predict, RESULTS)


def fold(id_col: Column, folds: int) -> Column:
    """Fold number of a document: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(folds)
