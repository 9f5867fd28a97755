"""Substring dedup by difference-cover anchors.

A window of ``WINDOW`` words is repeated if its word sequence also starts
anywhere else.  Only positions whose number modulo ``PERIOD`` lies in the
difference cover are hashed (``ANCHOR`` words each): for any two starts i and j
the cover has a shift d < PERIOD with both i + d and j + d in it, so two equal
windows share an aligned anchor as long as ``ANCHOR + PERIOD - 1 <= WINDOW``.

1. Anchors meet in a packed exchange (``fingerprints``); those that occur once
   are dropped.  Documents without a repeated anchor are done: nothing goes.
2. Repeated anchors are extended on either side to the windows that hold them
   at an aligned shift; the 64-bit fingerprints of those windows meet in a
   second exchange, and windows that occur twice are repeated.
3. Words covered by repeated windows are removed.

The places of either exchange are written before the texts move, so that one
exchange's files are gone before the next one's come.

Window fingerprints use two independent polynomial hashes folded into 64 bits;
a pair of different windows is taken for equal with probability 2**-64.

Defined results: null and empty texts have no words and keep the empty text;
texts shorter than a window keep all words; repeated rows repeat each other, so
their windows go in both; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints, rows, scan

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 occurs (a perfect difference set)
ANCHOR = WINDOW - PERIOD + 1


def shift_table(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """Is a position modulo the period in the cover?  Checks the cover."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    table = np.zeros(period, bool)
    table[list(cover)] = True
    return table


_IN_COVER = shift_table()


def _sums(buf, starts, ends) -> list[np.ndarray]:
    return [scan.prefix(scan.word_hashes(buf, starts, ends, w), w + 2) for w in (0, 1)]


def _hash(sums: list[np.ndarray], lo: np.ndarray, n: int) -> np.ndarray:
    a, b = (scan.range_hash(sums[w], lo, lo + n, w + 2) for w in (0, 1))
    return scan.mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15)))


def anchors(buf: np.ndarray, offsets: np.ndarray):
    """(fingerprint, document, word place) of all anchors of a flat chunk."""
    starts, ends, first = scan.words(buf, offsets)
    if len(starts) < ANCHOR:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    doc = scan.owner(first)
    place = np.arange(len(starts)) - first[doc]
    n = np.diff(first)[doc]
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + ANCHOR <= n) & (n >= WINDOW))
    return _hash(_sums(buf, starts, ends), at, ANCHOR), doc[at], place[at]


def windows(buf: np.ndarray, offsets: np.ndarray, held: list[np.ndarray]):
    """(fingerprint, document, word place) of the windows that hold one of the
    repeated anchors ``held[document]`` at a shift below the period."""
    starts, ends, first = scan.words(buf, offsets)
    n = np.diff(first)
    at = []
    for d, anchor in enumerate(held):
        if len(anchor) and n[d] >= WINDOW:
            last = n[d] - WINDOW
            lo, hi = np.maximum(anchor - PERIOD + 1, 0), np.minimum(anchor, last) + 1
            ok = lo < hi
            at.append(first[d] + np.flatnonzero(scan.covered(last + 1, lo[ok], hi[ok])))
    if not at:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    at = np.concatenate(at)
    doc = scan.owner(first)[at]
    return _hash(_sums(buf, starts, ends), at, WINDOW), doc, at - first[doc]


def _places(hits: DataFrame) -> DataFrame:
    """Sorted distinct places per document; a document's list is as long as its text."""
    return hits.groupBy(*rows.KEY).agg(F.sort_array(F.collect_set("place")).alias("places"))


def _held(column: pa.Array, lo: int, hi: int) -> list[np.ndarray]:
    part = column.slice(lo, hi - lo)
    empty = np.zeros(0, np.int64)
    return [empty if v is None else np.asarray(v, np.int64) for v in part.to_pylist()]


def _removed(buf, offsets, held):
    """(words, removed words, kept words joined by one space) per document."""
    starts, ends, first = scan.words(buf, offsets)
    raw = buf.tobytes()
    for d, windows_ in enumerate(held):
        a, b = int(first[d]), int(first[d + 1])
        gone = np.zeros(b - a, bool)
        if len(windows_):
            gone = scan.covered(b - a, windows_, windows_ + WINDOW)
        s, e = starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist()
        yield b - a, int(gone.sum()), b" ".join([raw[i:j] for i, j in zip(s, e)])


RESULT = ("n_words", "n_removed", "kept_sha256")


def _finished(batch: pa.RecordBatch, with_text: bool):
    """Result columns (lists) of a batch with ``text`` and ``places``."""
    out: list[list] = [[], [], [], []]
    buf, off = scan.texts_of(batch.column("text"))
    for lo, hi in scan.chunks(off):
        held = _held(batch.column("places"), lo, hi)
        for n, gone, kept in _removed(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], held):
            out[0].append(n)
            out[1].append(gone)
            out[2].append(hashlib.sha256(kept).hexdigest())
            out[3].append(kept.decode("utf-8") if with_text else None)
    return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256 (and the
    kept text, ``kept``, if asked for)."""
    base = rows.keyed(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col, "text").select(
        *rows.KEY, "text", id_col)
    parts = fingerprints.parts_for(docs)
    id_type = dict(docs.dtypes)[id_col]
    result = "n_words long, n_removed long, kept_sha256 string, kept string"

    # 1. repeated anchors
    first = fingerprints.packed(base.select(*rows.KEY, "text"), fingerprints.chunked_find(anchors), parts)
    anchored = rows.stage(_places(fingerprints.repeated(first)), "cover-anchors")

    # Documents without repeated anchors are finished at once, the others keep their text for the next step.
    def settle(batches):
        for batch in batches:
            done = np.asarray(batch.column("places").is_null())
            todo = pa.array(~done)
            rest = batch.filter(todo)
            keys = [batch.filter(pa.array(done)), rest]
            blank = [pa.nulls(rest.num_rows, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            for part, cols, open_ in ((keys[0], _finished(keys[0], with_text), False), (rest, blank, True)):
                n = part.num_rows
                text = part.column("text") if open_ else pa.nulls(n, batch.column("text").type)
                places = part.column("places") if open_ else pa.nulls(n, batch.column("places").type)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ka"), part.column("kb"), part.column(id_col), text, places, *cols],
                    ["ka", "kb", id_col, "text", "places", *RESULT, "kept"])

    split = rows.stage(base.join(anchored, list(rows.KEY), "left").mapInArrow(
        settle, f"ka long, kb long, `{id_col}` {id_type}, text string, places array<long>, {result}"), "cover-docs")
    names = [id_col, *RESULT] + ["kept"] * with_text
    todo = split.where("places is not null").select(*rows.KEY, "text", "places", id_col)

    # 2. extension to windows
    def extend(batch: pa.RecordBatch):
        buf, off = scan.texts_of(batch.column(2))
        for lo, hi in scan.chunks(off, fingerprints.PACK_BYTES):
            fp, doc, place = windows(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], _held(batch.column(3), lo, hi))
            yield fp, doc + lo, place

    second = fingerprints.packed(todo.select(*rows.KEY, "text", "places"), extend, parts)
    found = rows.stage(_places(fingerprints.repeated(second)), "cover-windows")

    # 3. removal
    def remove(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *_finished(batch, with_text)],
                                             [id_col, *RESULT, "kept"])

    last = todo.drop("places").join(found, list(rows.KEY), "left").mapInArrow(remove, f"`{id_col}` {id_type}, {result}")
    return split.where("places is null").select(*names).unionByName(last.select(*names))
