"""Which fingerprints occur more than once: a packed exchange.

Operators that look for repeated content produce one 64-bit fingerprint for
every few bytes of text.  Shuffling those as rows costs a row each; here a
task packs the fingerprints of a chunk of documents into one row per hash
partition, so an entry costs its bytes (fingerprint, document and place).

Inside a chunk, equal fingerprints are folded to one entry first: those are
known to repeat and need no exchange for themselves.  A fingerprint that a
third of all documents share therefore costs one entry per chunk, and the
partition that receives it grows with the chunks, not with the documents.

``references`` are two integers per entry: the document's number in the chunk
(the row carries the chunk's document keys) and the place in the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

PACK_BYTES = 4 << 20  # text bytes of a chunk whose fingerprints travel together
PACKED = "part int, fps binary, docs binary, places binary, ka binary, kb binary, own boolean"
_NAMES = ["part", "fps", "docs", "places", "ka", "kb", "own"]
HITS = "ka long, kb long, fp long, place long"

# (bytes, offsets) -> (fingerprints, document numbers, places)
Fingerprinter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def parts_for(df: DataFrame) -> int:
    """Hash partitions of an exchange: a few per shuffle partition, so that one
    holds a small share of a task's memory."""
    return 4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _row(part: int, fp, doc, place, ka, kb, own: bool) -> tuple:
    used, doc = np.unique(doc, return_inverse=True)
    return (part, fp.astype("<u8").tobytes(), doc.astype("<i4").tobytes(), place.astype("<i4").tobytes(),
            ka[used].astype("<i8").tobytes(), kb[used].astype("<i8").tobytes(), own)


def packed(keyed_texts: DataFrame, find: Callable[[pa.RecordBatch], Iterator[tuple]], parts: int) -> DataFrame:
    """Packed fingerprints of ``keyed_texts`` (ka, kb, text, ...).  ``find``
    yields (fingerprints, rows, places) for chunks of a batch.

    Rows with ``own`` hold entries that repeat inside their chunk: they are hits
    already.  The other rows hold every distinct fingerprint of the chunk once."""
    def pack(batches):
        for batch in batches:
            ka = np.asarray(batch.column(0)).astype(np.int64)
            kb = np.asarray(batch.column(1)).astype(np.int64)
            for fp, doc, place in find(batch):
                if not len(fp):
                    continue
                order = np.argsort(fp, kind="stable")
                fp, doc, place = fp[order], doc[order], place[order]
                first = np.ones(len(fp), bool)
                first[1:] = fp[1:] != fp[:-1]
                size = np.diff(np.append(np.flatnonzero(first), len(fp)))
                many = np.repeat(size > 1, size)
                out = []
                if many.any():
                    # Hits already; they ride along to any partition.
                    out.append(_row(int(fp[0] % np.uint64(parts)), fp[many], doc[many], place[many], ka, kb, True))
                # The first entry of each fingerprint travels; the high bits choose its partition.
                f, d, p, solo = fp[first], doc[first], place[first], ~many[first]
                # An entry whose fingerprint repeats here has its hits already: place -1 says so.
                p = np.where(solo, p, -1)
                part = ((f >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
                by = np.lexsort((place[first], d, part))  # neighbours compress well
                f, d, p, part = f[by], d[by], p[by], part[by]
                cut = np.searchsorted(part, np.arange(parts + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    a, b = cut[i], cut[i + 1]
                    out.append(_row(int(i), f[a:b], d[a:b], p[a:b], ka, kb, False))
                cols = list(zip(*out))
                types = [pa.int32(), *[pa.binary()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _NAMES)

    return keyed_texts.mapInArrow(pack, PACKED)


def _open(row: dict):
    ka, kb = np.frombuffer(row["ka"], "<i8"), np.frombuffer(row["kb"], "<i8")
    doc = np.frombuffer(row["docs"], "<i4")
    return np.frombuffer(row["fps"], "<u8"), ka[doc], kb[doc], np.frombuffer(row["places"], "<i4").astype(np.int64)


def _hits(ka, kb, fp, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ka), pa.array(kb), pa.array(fp.view(np.int64)), pa.array(place)],
                                      ["ka", "kb", "fp", "place"])


def repeated(rows_: DataFrame) -> DataFrame:
    """Entries (ka, kb, fp, place) whose fingerprint occurs at least twice."""
    def meet(table: pa.Table) -> pa.Table:
        held = table.select(["fps", "docs", "places", "ka", "kb", "own"]).to_pylist()
        out = [_hits(ka, kb, fp, place) for fp, ka, kb, place in (_open(r) for r in held if r["own"])]
        got = [_open(r) for r in held if not r["own"]]
        if got:
            fp = np.concatenate([g[0] for g in got])
            order = np.argsort(fp, kind="stable")
            s = fp[order]
            same = s[1:] == s[:-1]
            hit = np.zeros(len(s), bool)
            hit[1:] |= same
            hit[:-1] |= same
            take = order[hit]
            ka, kb, place = (np.concatenate([g[i] for g in got])[take] for i in (1, 2, 3))
            alone = place >= 0  # entries that repeat in their own chunk are hits already
            out.append(_hits(ka[alone], kb[alone], fp[take][alone], place[alone]))
        return pa.Table.from_batches(out)

    return rows_.groupBy("part").applyInArrow(meet, HITS)


def chunked_find(find: Fingerprinter, column: int = 2, limit: int = PACK_BYTES):
    """``packed``'s ``find`` from a function of a flat text chunk.  Texts are
    hashed in small chunks and gathered to one pack per ``limit`` bytes."""
    def run(batch: pa.RecordBatch):
        buf, off = scan.texts_of(batch.column(column))
        for lo, hi in scan.chunks(off, limit):
            held = []
            sub = off[lo:hi + 1] - off[lo]
            for a, b in scan.chunks(sub):
                fp, doc, place = find(buf[off[lo] + sub[a]:off[lo] + sub[b]], sub[a:b + 1] - sub[a])
                held.append((fp, doc + (lo + a), place))
            yield tuple(np.concatenate(x) for x in zip(*held))
    return run
