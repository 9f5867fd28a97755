"""Suffix-array dedup with run-length indexes.

A byte is removed if a 400-byte string that covers it also starts anywhere
else.  The strings of a corpus are split so that equal strings meet:

1. Every window of ``WINDOW`` bytes is owned by its minimizer (the smallest
   ``GRAM``-byte hash in it).  Consecutive windows of one owner form a segment;
   equal windows have equal owners, so they lie in segments of one owner.
   Owner hashes meet in a packed exchange; documents without a repeated owner
   are finished, the others keep the segments of repeated owners as narrow rows
   (owner hash, text hash, document, place, windows).
2. Equal segments are folded: their windows occur in each of them.  Owners
   with several different segment texts need an index; one text of each is
   fetched and shipped to the owner's index group.
3. Per group a run-compressed Burrows-Wheeler transform is built over the
   texts, with suffix-array samples at the run ends.  Lengths of matches with
   the neighbouring suffixes are computed at the run ends only and streamed
   through the text: from one position to the next a match is one byte shorter
   until the next sample.  Windows whose match is long enough are marked.
4. An owner with more different texts than ``GROUP_TEXTS`` would not fit one
   task; its segments are cut again by windows of their own (every window an
   owner), where equal windows are equal segments and folding alone decides.

Defined results: null and empty texts have no bytes; texts shorter than a
window keep all bytes; repeated rows repeat each other and lose their long
texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints, rows, scan

WINDOW = 400
GRAM = 160
PLACE_BITS = 24  # a flat chunk is shorter than 2**24 bytes (see _texts)
GROUP_TEXTS = 4_000  # different segment texts of one owner that one index takes
GROUP_BYTES = 1 << 20  # text bytes per index group, about


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (two passes over blocks)."""
    n = len(x)
    pad = -n % w
    a = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def segments(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(document, place, windows, owner hash, text hash) of the segments of a flat chunk.

    Places count from the start of the document; a segment of ``windows``
    windows covers ``windows + window - 1`` bytes."""
    z = np.zeros(0, np.int64)
    n = len(buf)
    if n < window:
        return z, z, z, z, z
    sums = [scan.prefix(scan.byte_values(buf, w), w) for w in (0, 1)]
    grams = np.arange(n - gram + 1)
    h = scan.range_hash(sums[0], grams, grams + gram, 0)
    # Rank value: high bits of the hash, then the place, so the leftmost of equals wins.
    bits = np.uint64(PLACE_BITS)
    value = ((h >> bits) << bits) | grams.astype(np.uint64)
    best = sliding_min(value, window - gram + 1)
    place = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows inside one document.
    starts = np.arange(n - window + 1)
    doc = scan.owner(offsets)
    ok = doc[starts] == doc[starts + window - 1]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | ~ok[:-1] | (doc[1:len(starts)] != doc[:len(starts) - 1])
    first = np.flatnonzero(new & ok)
    if not len(first):
        return z, z, z, z, z
    edge = np.flatnonzero(new | ~ok)
    nxt = np.append(edge, len(starts))[np.searchsorted(edge, first, "right")]
    count = nxt - first
    end = first + count - 1 + window
    text = scan.mix(scan.range_hash(sums[0], first, end, 0)
                    ^ (scan.range_hash(sums[1], first, end, 1) * np.uint64(0x9E3779B97F4A7C15)))
    d = doc[first]
    # The owner: hash of its bytes by the second table, independent of the ranking.
    own = scan.range_hash(sums[1], place[first], place[first] + gram, 1)
    return d, first - offsets[d], count, own.view(np.int64), text.view(np.int64)


def _texts(batch: pa.RecordBatch, column: int, limit: int = scan.CHUNK_BYTES, window: int = WINDOW):
    """Flat chunks of a batch as (bytes, offsets, first row, shift); a document
    longer than the limit comes in pieces that overlap by a window less a byte."""
    buf, off = scan.texts_of(batch.column(column))
    for lo, hi in scan.chunks(off, limit):
        a, b = int(off[lo]), int(off[hi])
        if hi - lo == 1 and b - a > 2 * limit:
            for at in range(a, b - window + 1, limit):
                stop = min(at + limit + window - 1, b)
                yield buf[at:stop], np.array([0, stop - at]), lo, at - a
        else:
            yield buf[a:b], off[lo:hi + 1] - a, lo, 0


SEGMENT = "ka long, kb long, place int, windows int, own long, text long"
SEGMENT_NAMES = [f.split(" ")[0] for f in SEGMENT.split(", ")]


def owner_finder(window: int = WINDOW, gram: int = GRAM):
    """Owner hashes of all segments, for the packed exchange."""
    def find(batch: pa.RecordBatch):
        held, size = [], 0
        for buf, off, row, shift in _texts(batch, 2, window=window):
            doc, place, _, own, _ = segments(buf, off, window, gram)
            held.append((own.view(np.uint64), doc + row, place + shift))
            size += len(buf)
            if size >= fingerprints.PACK_BYTES:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))
    return find


def segment_rows(todo: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Segments whose owner is repeated; ``todo``: ka, kb, text, places."""
    def cut(batches):
        for batch in batches:
            ka, kb = (np.asarray(batch.column(i)) for i in (0, 1))
            held = batch.column(3).to_pylist()
            for buf, off, row, shift in _texts(batch, 2, window=window):
                doc, place, count, own, text = segments(buf, off, window, gram)
                place = place + shift
                wanted = np.concatenate([np.asarray(held[row + d], np.int64) | (d << 40) for d in range(len(off) - 1)])
                live = np.isin(place | (doc << 40), wanted)
                doc = doc[live] + row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ka[doc]), pa.array(kb[doc]), pa.array(place[live], pa.int32()),
                     pa.array(count[live], pa.int32()), pa.array(own[live]), pa.array(text[live])], SEGMENT_NAMES)

    return todo.mapInArrow(cut, SEGMENT)


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of the integers ``x`` by prefix doubling up to
    ``depth`` characters; suffixes equal that far keep their text order."""
    n = len(x)
    # As many leading symbols as one integer holds are ranked at once.
    width = int(x.max()) + 2
    k = max(1, int(62 // np.log2(width)))
    key = np.zeros(n, np.int64)
    for i in range(k):
        key *= width
        key[:max(n - i, 0)] += x[i:] + 1
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[:max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        step = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if step[-1] == n - 1 or k >= depth:
            return order, rank


class RunIndex:
    """Run-compressed transform of a text collection with sampled run ends."""

    def __init__(self, texts: list[bytes], depth: int):
        sizes = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
        # Every text ends with a separator of its own, so no match runs past it.
        flat[self.starts + sizes] = np.arange(len(texts))
        self.depth, self.flat = depth, flat
        sa, _ = suffix_array(flat, depth)
        n = len(flat)
        last = flat[sa - 1]  # the transform; position -1 is the last separator
        head = np.ones(n, bool)
        head[1:] = last[1:] != last[:-1]
        self.runs = int(head.sum())
        self.run_symbols, self.run_heads = last[head], np.flatnonzero(head)
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        # Match length with the suffix above is sampled at run heads, with the one below at run tails.
        self.above = self._sampled(sa[head], np.where(np.flatnonzero(head) > 0, sa[np.flatnonzero(head) - 1], -1))
        below = np.flatnonzero(tail)
        self.below = self._sampled(sa[tail], np.where(below < n - 1, sa[np.minimum(below + 1, n - 1)], -1))

    def _sampled(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, match lengths up to the depth) of sampled suffixes, in text order."""
        order = np.argsort(at)
        at, other = at[order], other[order]
        length = np.zeros(len(at), np.int64)
        n = len(self.flat)
        live = np.flatnonzero(other >= 0)
        # Doubling steps down: compare blocks by hashes of the text.
        sums = scan.prefix(scan.mix(self.flat.astype(np.uint64)), 3)
        step = 1 << (self.depth.bit_length() - 1)
        while step and len(live):
            a, b = at[live] + length[live], other[live] + length[live]
            fits = (a + step <= n) & (b + step <= n)
            hit = live[fits]
            a, b = a[fits], b[fits]
            equal = scan.range_hash(sums, a, a + step, 3) == scan.range_hash(sums, b, b + step, 3)
            length[hit[equal]] += step
            step >>= 1
        return at, length

    def statistics(self) -> np.ndarray:
        """For every text position, the longest match with another position
        (at least the depth where it is that long), streamed from the samples."""
        n = len(self.flat)
        best = np.zeros(n, np.int64)
        for at, length in (self.above, self.below):
            where = np.searchsorted(at, np.arange(n), "right") - 1
            ok = where >= 0
            best[ok] = np.maximum(best[ok], length[where[ok]] - (np.flatnonzero(ok) - at[where[ok]]))
        return best


def repeated_windows(texts: list[bytes], window: int) -> list[np.ndarray]:
    """Window starts of each text that occur at another start of the collection."""
    index = RunIndex(texts, 2 * max(len(t) for t in texts))
    stats = index.statistics()
    return [np.flatnonzero(stats[s:s + max(len(t) - window + 1, 0)] >= window) for s, t in zip(index.starts, texts)]


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers as [first, last] pairs."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


MARK = "own long, text long, first int, last int"


def index_marks(base: DataFrame, wanted: DataFrame, window: int, groups: int) -> DataFrame:
    """Marked window ranges (relative to the segment) of the ``wanted`` segments
    (ka, kb, place, windows, own, text: one per different text)."""
    places = wanted.groupBy(*rows.KEY).agg(F.collect_list(F.struct("place", "windows", "own", "text")).alias("segs"))

    def fetch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py().encode()
                segs = batch.column(1)[i].as_py()
                if not segs:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["own"] for s in segs]), pa.array([s["text"] for s in segs]),
                     pa.array([raw[s["place"]:s["place"] + s["windows"] + window - 1] for s in segs], pa.binary())],
                    ["own", "text", "bytes"])

    # Repeated rows share a key; either of them gives the same bytes.
    texts = (base.select(*rows.KEY, "text").withColumnRenamed("text", "body").join(places, list(rows.KEY))
             .select("body", "segs").mapInArrow(fetch, "own long, text long, bytes binary")
             .withColumn("part", F.pmod("own", F.lit(groups)).cast("int")))

    def search(table: pa.Table) -> pa.Table:
        own, text = np.asarray(table.column("own")), np.asarray(table.column("text"))
        _, pick = np.unique(text, return_index=True)  # a text fetched from several repeated rows counts once
        texts_ = table.column("bytes").take(pa.array(pick)).to_pylist()
        found = repeated_windows(texts_, window)
        out = [(own[p], text[p], a, b) for p, at in zip(pick, found) for a, b in zip(*_ranges(at))]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                        names=["own", "text", "first", "last"])

    return texts.groupBy("part").applyInArrow(search, MARK)


def _single_windows(base: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Segments of hot owners cut to one window each, as (ka, kb, place, text)."""
    places = hot.groupBy(*rows.KEY).agg(F.collect_set(F.struct("place", "windows")).alias("segs"))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                buf = np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8)
                at = [np.arange(s["place"], s["place"] + s["windows"]) for s in batch.column(3)[i].as_py()]
                at = np.unique(np.concatenate(at))
                sums = [scan.prefix(scan.byte_values(buf, w), w) for w in (0, 1)]
                h = scan.mix(scan.range_hash(sums[0], at, at + window, 0)
                             ^ (scan.range_hash(sums[1], at, at + window, 1) * np.uint64(0x9E3779B97F4A7C15)))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())),
                     pa.array(at, pa.int32()), pa.array(h.view(np.int64))], ["ka", "kb", "place", "text"])

    return (base.select(*rows.KEY, "text").join(places, list(rows.KEY))
            .mapInArrow(cut, "ka long, kb long, place int, text long"))


def repeated_ranges(todo: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    group_texts: int = GROUP_TEXTS) -> DataFrame:
    """Repeated window starts as ranges per document: ka, kb, ``spans`` (array
    of first and last start).  ``todo``: ka, kb, text and the ``places`` of
    segments whose owner occurs more than once."""
    live = rows.stage(segment_rows(todo, window, gram), "segments")
    # Repeated rows share their key: each of them is an occurrence.
    folded = live.groupBy("own", "text").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ka", "kb", "place", "windows")).alias("one"))
    folded = rows.stage(folded, "segments-folded")
    many = folded.groupBy("own").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    many = rows.stage(many, "segments-owners")
    totals = many.agg(F.sum("texts").alias("s"), F.max("texts").alias("m")).first()
    least = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, -(-int(totals["s"] or 0) * (window + window // 2) // GROUP_BYTES))
    wanted = (folded.join(many.where(F.col("texts") <= group_texts), "own")
              .select("own", "text", "one.*"))
    marks = index_marks(todo, wanted, window, groups)
    whole = folded.where("n > 1").select("own", "text")
    spans = live.join(whole, ["own", "text"], "left_semi").select(
        *rows.KEY, F.col("place").alias("a"), (F.col("place") + F.col("windows") - 1).alias("b"))
    marked = (live.join(marks, ["own", "text"])
              .select(*rows.KEY, (F.col("place") + F.col("first")).alias("a"), (F.col("place") + F.col("last")).alias("b")))
    spans = spans.unionByName(marked)
    if (totals["m"] or 0) > group_texts:
        hot = live.join(many.where(F.col("texts") > group_texts), "own", "left_semi")
        single = rows.stage(_single_windows(todo, hot, window), "segments-single")
        again = single.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        spans = spans.unionByName(single.join(again, "text", "left_semi")
                                  .select(*rows.KEY, F.col("place").alias("a"), F.col("place").alias("b")))
    return spans.groupBy(*rows.KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _cut_text(raw: bytes, held: list | None, window: int, with_text: bool) -> tuple:
    if not held:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode() if with_text else None
    first = np.array([s["a"] for s in held])
    gone = scan.covered(len(raw), first, np.array([s["b"] for s in held]) + window)
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(),
            kept.decode("utf-8", "ignore") if with_text else None)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
          window: int = WINDOW, gram: int = GRAM, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """One row per document: all columns but the text, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and, if asked for, the kept text in the text
    column (bytes of characters that were cut in two are left out there)."""
    others = [c for c in docs.columns if c != text_col]
    names = [f"_o{i}" for i in range(len(others))]
    types = dict(docs.dtypes)
    plain = docs.select(F.col(text_col).alias("_t"), F.col(id_col).alias("_id"),
                        *[F.col(c).alias(n) for c, n in zip(others, names)])
    base = rows.keyed(plain, "_id", "_t").select(*rows.KEY, F.coalesce("_t", F.lit("")).alias("text"), *names)
    owners = fingerprints.packed(base.select(*rows.KEY, "text"), owner_finder(window, gram), fingerprints.parts_for(docs))
    places = fingerprints.repeated(owners).groupBy(*rows.KEY).agg(F.collect_set("place").alias("places"))
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    carried = ", ".join(f"{n} {types[c]}" for n, c in zip(names, others))
    carried = carried + ", " if carried else ""

    # Documents without a repeated owner are finished at once, the others keep their text.
    def settle(batches):
        for batch in batches:
            open_ = np.asarray(batch.column("places").is_valid())
            for pick in (True, False):
                part = batch.filter(pa.array(open_ == pick))
                n = part.num_rows
                if pick:
                    text, held, cols = part.column("text"), part.column("places"), [pa.nulls(n, t) for t in _KINDS]
                else:
                    out = [_cut_text(v.as_py().encode(), None, window, with_text) for v in part.column("text")]
                    text, held = pa.nulls(n, batch.column("text").type), pa.nulls(n, batch.column("places").type)
                    cols = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, _KINDS)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("ka"), part.column("kb"), text, held, *[part.column(c) for c in names], *cols],
                    ["ka", "kb", "text", "places", *names, *RESULT])

    split = rows.stage(base.join(places, list(rows.KEY), "left").mapInArrow(
        settle, f"ka long, kb long, text string, places array<long>, {carried}{result}"), "segments-docs")
    todo = split.where("places is not null")
    found = repeated_ranges(todo.select(*rows.KEY, "text", "places"), window, gram, group_texts)

    def remove(batches):
        for batch in batches:
            out = [_cut_text(t.as_py().encode(), s.as_py(), window, with_text)
                   for t, s in zip(batch.column("text"), batch.column("spans"))]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, _KINDS)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *cols], [*names, *RESULT])

    last = (todo.select(*rows.KEY, "text", *names).join(found, list(rows.KEY), "left")
            .mapInArrow(remove, f"{carried}{result}"))
    done = split.where("places is null").select(*names, *RESULT).unionByName(last)
    back = [F.col(n).alias(c) for n, c in zip(names, others)]
    return done.select(*back, *RESULT[:4], *([F.col("kept").alias(text_col)] if with_text else []))
