"""Quality rules by distribution divergence.

Two passes, no shuffle of texts.  The first counts, per language tag, the
shares of the character classes (as histograms of ``BINS`` bins) and the words
(hashed to ``CELLS`` cells) of all documents that pass the base rules; the
counts are pre-aggregated per task and summed in slices.  A language reference
is its character-class distribution (the normalised median shares, which a
minority of junk does not move) and the distribution over its ``COMMON`` most
frequent cells (the rest is one bin).  A tag gives a reference only from
``MIN_REF_DOCS`` documents and ``MIN_REF_RUNS`` letter runs on, in corpora of
every size; the documents of other tags are judged by the references there are.
The second pass compares every document with every reference by the
Jensen-Shannon distance (square root of the divergence, base 2) and rejects it
when even the nearest reference is too far.  Both limits shrink with the length
of the document to a base, as the sampling noise of its shares does.  A
reference whose common cells hold so few letter runs that even a text of
``JUDGED_RUNS`` runs without any of them is within the limit (a script without
blanks, say) judges no words: documents nearest to it by classes are not tested
on words, the others are tested on the other references.  The tag of the
document itself is not used in the verdict.

Base rules: fewer than ``MIN_WORDS`` words, or more than ``REPEAT_PERCENT``
percent of words inside repeated 8-word windows.

Defined results: null or empty text has no words and fails the base rules; a
document shorter than the guards (``MIN_CHARS`` for classes, ``MIN_TOKENS`` for
words) is not tested on that histogram; null languages give no reference;
without any reference only the base rules hold; repeated rows get equal rows;
other columns are kept by ``judge`` and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rows, scan

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
CELLS = 1 << 16
SLICE = 1 << 10
HELD_TAGS = 64  # tags whose counters a task holds at once (half a MB each)
COMMON = 64
BINS = 512
MIN_CHARS = 200
MIN_TOKENS = 50
MAX_CLASS_DISTANCE = 0.16
CLASS_NOISE = 1.0  # sampling noise of a class histogram: added as CLASS_NOISE / sqrt(characters)
MAX_WORD_DISTANCE = 0.15
WORD_NOISE = 3.2  # sampling noise of a word histogram: added as WORD_NOISE / sqrt(letter runs)
JUDGED_RUNS = 1000  # a reference must tell a text of so many letter runs without common words
MIN_REF_DOCS = 30  # documents of MIN_CHARS that pass the base rules, per reference
MIN_REF_RUNS = 2000

# Character classes by byte (fixed values): a multi-byte character counts once, by its lead byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "other", "wide", "tail")
_CLASS = np.full(256, CLASSES.index("other"), dtype=np.int64)
_CLASS[ord("a"):ord("z") + 1] = CLASSES.index("lower")
_CLASS[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
_CLASS[ord("0"):ord("9") + 1] = CLASSES.index("digit")
_CLASS[[0x20, 0x09]] = CLASSES.index("space")
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = CLASSES.index("newline")
_CLASS[[ord(c) for c in ".,"]] = CLASSES.index("stop")
_CLASS[[ord(c) for c in "!?;:"]] = CLASSES.index("mark")
_CLASS[[ord(c) for c in "#*$%&|<>"]] = CLASSES.index("symbol")
_CLASS[0xC0:] = CLASSES.index("wide")
_CLASS[0x80:0xC0] = CLASSES.index("tail")
KINDS = CLASSES.index("tail")  # continuation bytes are no characters
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[0x80:] = True

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def repeated(doc: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its document, occurs earlier in its document)."""
    n = len(doc)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n == 0:
        return again, later
    order = np.lexsort((np.arange(n), *hashes, doc))
    same = np.ones(n - 1, bool)
    for a in (doc, *hashes):
        s = a[order]
        same &= s[1:] == s[:-1]
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def base_metrics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base metrics of every document of a flat chunk."""
    docs = len(offsets) - 1
    starts, ends, first = scan.words(buf, offsets)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_doc(~scan.SPACE[buf] & ((buf & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[buf], offsets)
    # Lines with a word; equal lines have equal 128-bit hashes.
    sums = [scan.prefix(scan.byte_values(buf, w), w) for w in (0, 1)]
    ls, le, lfirst = scan.runs(buf != 0x0A, offsets)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    owner = scan.owner(lfirst)[has]
    ls, le = ls[has], le[has]
    _, later = repeated(owner, scan.range_hash(sums[0], ls, le, 0), scan.range_hash(sums[1], ls, le, 1))
    out["n_dup_lines"] = np.bincount(owner[later], minlength=docs)
    # Words inside 8-word windows that occur twice.
    marks = np.zeros(len(starts), dtype=bool)
    lo = np.arange(max(0, len(starts) - WINDOW + 1))
    doc_of = scan.owner(first)
    if len(lo):
        lo = lo[doc_of[lo] == doc_of[lo + WINDOW - 1]]
        hs = [scan.range_hash(scan.prefix(scan.range_hash(sums[w], starts, ends, w), w + 2), lo, lo + WINDOW, w + 2)
              for w in (0, 1)]
        again, _ = repeated(doc_of[lo], *hs)
        marks = scan.covered(len(starts), lo[again], lo[again] + WINDOW)
    out["n_repeat_words"] = np.bincount(doc_of[marks], minlength=docs)
    return out


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def class_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs, width = len(offsets) - 1, len(CLASSES)
    at = scan.owner(offsets) * width + _CLASS[buf]
    return np.bincount(at, minlength=docs * width).reshape(docs, width)[:, :KINDS]


def cells_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each letter run, its document); A-Z and a-z count as equal."""
    starts, ends, first = scan.runs(_LETTER[buf], offsets)
    h = scan.word_hashes(scan.LOWER[buf], starts, ends)
    return (h & np.uint64(CELLS - 1)).astype(np.int64), scan.owner(first)


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[dict]:
    """One reference per language tag with enough documents: ``lang``,
    ``classes`` (distribution), ``cells`` and ``shares`` (common cells, rest last)."""
    def rows_of(total):
        """The non-zero counters of ``total``: tag, slice (-1: classes), places in it, counts."""
        out = []
        for tag, (hist, cells) in total.items():
            for part, c in [(-1, hist), *((s // SLICE, cells[s:s + SLICE]) for s in range(0, CELLS, SLICE))]:
                at = np.flatnonzero(c)
                if len(at):
                    out.append((tag, part, at.tolist(), c[at].tolist()))
        if out:
            tag, part, at, counts = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tag, pa.string()), pa.array(part, pa.int32()), pa.array(at, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["lang", "part", "i", "c"])

    def count(batches):
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            buf, off = scan.texts_of(batch.column(1))
            for lo, hi in scan.chunks(off):
                b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                good = ~base_failed(base_metrics(b, o))
                classes = class_counts(b, o)
                cell, doc = cells_of(b, o)
                tags = langs[lo:hi]
                for tag in {t for t in tags if t is not None}:
                    pick = good & (tags == tag)
                    if tag not in total:
                        if len(total) >= HELD_TAGS:
                            yield from rows_of(total)
                            total.clear()
                        total[tag] = [np.zeros(KINDS * BINS, np.int64), np.zeros(CELLS, np.int64)]
                    full = classes[pick & (classes.sum(1) >= MIN_CHARS)]
                    # Square-root bins: rare classes keep their resolution.
                    at = np.sqrt(full / np.maximum(full.sum(1, keepdims=True), 1)) * (BINS - 1) + 0.5
                    total[tag][0] += np.bincount((at.astype(np.int64) + np.arange(KINDS) * BINS).ravel(),
                                                 minlength=KINDS * BINS)
                    total[tag][1] += np.bincount(cell[pick[doc]], minlength=CELLS)
        yield from rows_of(total)

    parts = docs.select(lang_col, text_col).mapInArrow(count, "lang string, part int, i array<int>, c array<bigint>")
    # Written once: both reads below would count the texts again.
    one = rows.stage(parts.select("lang", "part", F.explode(F.arrays_zip("i", "c")).alias("x"))
                     .groupBy("lang", "part", F.col("x.i").alias("i")).agg(F.sum("x.c").alias("c")), "quality")
    cells = one.where("part >= 0").select("lang", (F.col("part") * SLICE + F.col("i")).alias("cell"), "c")
    by_lang = cells.groupBy("lang").agg(F.sum("c").alias("total"),
                                        F.slice(F.sort_array(F.collect_list(F.struct("c", "cell")), False),
                                                1, COMMON).alias("top"))
    classes = one.where("part < 0").groupBy("lang").agg(F.collect_list(F.struct("i", "c")).alias("classes"))
    refs = []
    for r in classes.join(by_lang, "lang").orderBy("lang").collect():
        hist = np.zeros(KINDS * BINS)
        for i, c in r["classes"]:
            hist[i] = c
        # Every document of a tag counts once in each class: a row's last sum is their number.
        run = hist.reshape(KINDS, BINS).cumsum(1)
        if run[0, -1] < MIN_REF_DOCS or r["total"] < MIN_REF_RUNS:
            continue  # too little text under the tag for a reference
        dist = ((run * 2 < run[:, -1:]).sum(1) / (BINS - 1)) ** 2
        top = sorted((x["cell"], x["c"]) for x in r["top"])
        share = np.array([c for _, c in top], dtype=float)
        share = np.append(share, r["total"] - share.sum()) / r["total"]
        refs.append({"lang": r["lang"], "classes": dist / dist.sum(),
                     "cells": np.array([c for c, _ in top]), "shares": share})
    return refs


def js_distance(counts: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, in [0, 1]) of each row of counts to ``ref``;
    a row without counts has distance 0."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + ref) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
        b = np.where(ref > 0, ref * np.log2(ref / m), 0.0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0.0)


def word_limit(runs: np.ndarray, max_word: float = MAX_WORD_DISTANCE) -> np.ndarray:
    """Largest word distance of a kept document of so many letter runs."""
    return max_word + WORD_NOISE / np.sqrt(np.maximum(runs, 1))


def judges_words(ref: dict, max_word: float = MAX_WORD_DISTANCE) -> bool:
    """Whether a text of ``JUDGED_RUNS`` letter runs without common cells is too far from ``ref``."""
    none = np.zeros((1, len(ref["shares"])))
    none[0, -1] = 1
    return bool(js_distance(none, ref["shares"])[0] > word_limit(JUDGED_RUNS, max_word))


def distances(buf: np.ndarray, offsets: np.ndarray, refs: list[dict], max_word: float = MAX_WORD_DISTANCE):
    """(class distance, word distance, letter runs, characters) to the nearest
    reference; the word distance is infinite where no reference judges words."""
    docs = len(offsets) - 1
    classes = class_counts(buf, offsets)
    cell, doc = cells_of(buf, offsets)
    n = np.bincount(doc, minlength=docs)
    by_class, by_word = np.full(docs, np.inf), np.full(docs, np.inf)
    wordless = np.zeros(docs, bool)  # nearest by classes to a reference that judges no words
    for ref in refs:
        near = js_distance(classes, ref["classes"])
        judging = judges_words(ref, max_word)
        wordless = np.where(near < by_class, not judging, wordless)
        by_class = np.minimum(by_class, near)
        if not judging:
            continue
        at = np.searchsorted(ref["cells"], cell)
        at = np.where(ref["cells"][np.minimum(at, len(ref["cells"]) - 1)] == cell, at, len(ref["cells"]))
        width = len(ref["shares"])
        counts = np.bincount(doc * width + at, minlength=docs * width).reshape(docs, width)
        by_word = np.minimum(by_word, js_distance(counts, ref["shares"]))
    by_word[wordless] = np.inf
    return by_class, by_word, n, classes.sum(1)


def judge(docs: DataFrame, refs: list[dict] | None = None, text_col: str = "text",
          max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``docs`` (all columns; its own column of this name is replaced) with the
    struct column ``quality``: the base metrics, ``base_failed``, the two distances
    (null where guarded) and ``kept``."""
    if refs is None:
        refs = references(docs, text_col=text_col)
    spec = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, class_distance double, word_distance double, kept boolean")
    fields = [f.split(" ") for f in spec.split(", ")]
    types = {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
    results = T.StructType([
        T.StructField("quality", T.StructType([T.StructField(n, types[t]) for n, t in fields]))])
    where = rows.place_of(docs, text_col, results)

    def test(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(where))
            for lo, hi in scan.chunks(off):
                b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                m = base_metrics(b, o)
                failed = base_failed(m)
                if refs:
                    dc, dw, tokens, chars = distances(b, o, refs, max_word)
                    has_c, has_w = chars >= MIN_CHARS, (tokens >= MIN_TOKENS) & np.isfinite(dw)
                else:
                    dc = dw = np.zeros(hi - lo)
                    has_c = has_w = np.zeros(hi - lo, bool)
                    chars = tokens = np.ones(hi - lo)
                kept = ~failed & ~(has_c & (dc > max_class + CLASS_NOISE / np.sqrt(np.maximum(chars, 1))))
                kept &= ~(has_w & (dw > word_limit(tokens, max_word)))
                cols = [pa.array(m[k], pa.int64()) for k in METRICS]
                cols += [pa.array(failed), pa.array(dc, pa.float64(), mask=~has_c),
                         pa.array(dw, pa.float64(), mask=~has_w), pa.array(kept)]
                q = pa.StructArray.from_arrays(cols, [n for n, _ in fields])
                yield [*batch.slice(lo, hi - lo).columns, q]

    return rows.map_with_results(docs, test, results)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, one named ``quality`` included."""
    plain, names = rows.hidden(docs)
    refs = references(plain, names["lang"], names["text"])
    return rows.shown(judge(plain, refs, names["text"]).where("quality.kept"), names)
