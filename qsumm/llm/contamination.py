"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item is cut into windows of ``WINDOW`` consecutive words (a shorter item is
one window).  A window is looked up in the documents as the set of its word
shingles (``SHINGLE`` words each):

1. Rarity: one pass over the documents counts the shingles that items have.  A
   window with a shingle that no document has cannot occur and goes at once.
2. Prefix: full containment needs every shingle of a window, so a prefix of one
   shingle suffices, and the rarest is taken: its occurrences are the candidates.
3. Length and position: an occurrence of the prefix shingle fixes where the
   window starts; starts before the document's first or ends after its last
   word are dropped.
4. Verification: the bytes of the item-sized document window, words joined by
   one space, are compared with the item's.

Windows are distinct texts with the list of their items, and come in blocks of
at most ``BLOCK_BYTES``: a pass over the documents holds one block, whose size
is bounded by that parameter, and there are as many passes as blocks.  Only the
runs and items of documents with hits leave a pass.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  Defined results: null, empty and word-less texts have no words
and no hits; items without words have no windows; equal items are all counted;
items without an id mark words but are not listed; repeated documents get equal
rows; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows, scan

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 16 << 20  # texts and item lists of the windows one pass holds

WORD = np.zeros(256, bool)
WORD[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True


class Words(NamedTuple):
    """Words of a flat chunk of texts: the words joined by single spaces, their
    starts and ends in that buffer, and the first word of each text."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, first = scan.runs(WORD[buf], offsets)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = scan.LOWER[buf[WORD[buf]]]
    return Words(joined, at[:-1], at[:-1] + size, first)


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all shingles of ``n`` words inside the texts."""
    room = w.first[1:][scan.owner(w.first)] - np.arange(len(w.starts))
    at = np.flatnonzero(room >= n)
    sums = scan.prefix(scan.byte_values(w.buf), 0)
    return at, scan.range_hash(sums, w.starts[at], w.ends[at + n - 1], 0)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows: text, n (words), shingles (of ``min(shingle, n)`` words,
    in order), items (sorted distinct ids as strings)."""
    def cut(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(1))
            ids = batch.column(0)
            for lo, hi in scan.chunks(off):
                w = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                count = np.diff(w.first)
                out: list[list] = [[], [], [], []]
                raw = w.buf.tobytes()
                hashes = {}
                for n in {min(shingle, int(c)) for c in np.unique(count) if c}:
                    at, h = shingle_hashes(w, n)
                    hashes[n] = dict(zip(at.tolist(), h.view(np.int64).tolist()))
                for d in np.flatnonzero(count):
                    n = min(window, int(count[d]))
                    k = min(shingle, n)
                    for s in range(int(w.first[d]), int(w.first[d + 1]) - n + 1):
                        out[0].append(ids[lo + int(d)].as_py())
                        out[1].append(raw[w.starts[s]:w.ends[s + n - 1]].decode("utf-8"))
                        out[2].append(n)
                        out[3].append([hashes[k][i] for i in range(s, s + n - k + 1)])
                types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                                 ["item", "text", "n", "shingles"])

    flat = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        cut, "item string, text string, n int, shingles array<long>")
    return flat.groupBy("text").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"),
                                    F.sort_array(F.collect_set("item")).alias("items"))


def blocks(windows: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Windows with the number of their block: hash blocks of about half ``limit`` bytes."""
    size = (F.octet_length("text") + 8 * F.size("shingles") + 16 * (F.size("items") + 2)
            + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)))
    total = windows.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = max(1, -(-2 * int(total) // limit))
    return windows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ka, kb, id, text)."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.keyed(base, "id", "text").select(*rows.KEY, "id", "text")


def _chunks(column) -> Iterator[tuple[int, int, Words]]:
    buf, off = scan.texts_of(column)
    for lo, hi in scan.chunks(off):
        yield lo, hi, words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])


def shingle_counts(docs: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """(h, f): occurrences in the documents of the shingles ``known`` (sorted
    hashes by shingle length); every task adds its own first."""
    def count(batches):
        total = {n: np.zeros(len(h), np.int64) for n, h in known.items()}
        for batch in batches:
            for _, _, w in _chunks(batch.column("text")):
                for n, h in known.items():
                    at = _find(h, shingle_hashes(w, n)[1])
                    total[n] += np.bincount(at[at >= 0], minlength=len(h))
        for n, h in known.items():
            have = total[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(h[have].view(np.int64)), pa.array(total[n][have])], ["h", "f"])

    return docs.select("text").mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in ``sorted_`` (distinct), -1 where absent."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


class Index:
    """The windows of one block by their prefix shingle."""

    def __init__(self, found: list[tuple[str, int, int, int, int, list[str]]]):
        """``found``: (text, words, shingle words, prefix hash, prefix place, items)."""
        found = sorted(found, key=lambda r: (r[2], r[3] % (1 << 64), r[0]))
        texts = [r[0].encode("utf-8") for r in found]
        self.items = [r[5] for r in found]
        self.n, self.place = (np.array([r[i] for r in found], np.int64) for i in (1, 4))
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        width = np.array([r[2] for r in found], np.int64)
        prefix = np.array([r[3] for r in found], np.int64).view(np.uint64)
        self.heads = {}  # shingle words -> (distinct prefix hashes, first window of each, windows of each)
        for k in np.unique(width).tolist():
            lo, hi = np.searchsorted(width, [k, k + 1])
            h, first, many = np.unique(prefix[lo:hi], return_index=True, return_counts=True)
            self.heads[k] = (h, lo + first, many)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of all occurrences in a chunk, verified."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        owner = scan.owner(w.first)
        for k, (h, first, many) in self.heads.items():
            at, hashes = shingle_hashes(w, k)
            hit = _find(h, hashes)
            at, hit = at[hit >= 0], hit[hit >= 0]
            # windows that share the prefix shingle
            word = np.repeat(at, many[hit])
            nth = np.arange(len(word)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
            win = np.repeat(first[hit], many[hit]) + nth
            d = owner[word]
            start = word - self.place[win]
            end = start + self.n[win]
            ok = (start >= w.first[d]) & (end <= w.first[d + 1])
            win, start, end = win[ok], start[ok], end[ok]
            ok = w.ends[end - 1] - w.starts[start] == self.size[win]
            win, start = win[ok], start[ok]
            ok = self._equal(win, w.buf, w.starts[start])
            out.append((win[ok], start[ok]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _equal(self, win: np.ndarray, buf: np.ndarray, at: np.ndarray, limit: int = 4 << 20) -> np.ndarray:
        same = np.zeros(len(win), bool)
        ends = np.cumsum(self.size[win])
        lo = 0
        while lo < len(win):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            size = self.size[win[lo:hi]]
            base = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(base, size)
            differ = self.text[np.repeat(self.at[win[lo:hi]], size) + inner] != buf[np.repeat(at[lo:hi], size) + inner]
            same[lo:hi] = ~np.logical_or.reduceat(differ, base)
            lo = hi
        return same


def _hits_of_block(docs: DataFrame, index: Index, block: int) -> DataFrame:
    """(ka, kb, block, runs, items) of the documents that hold windows of the block."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def look(batches):
        index = held.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ka, kb = (np.asarray(batch.column(c)) for c in rows.KEY)
            for lo, _, w in _chunks(batch.column("text")):
                win, start = index.occurrences(w)
                d = scan.owner(w.first)[start]
                order = np.lexsort((start, d))
                win, start, d = win[order], start[order], d[order]
                cut = np.flatnonzero(np.diff(d, prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(d)]):
                    doc = int(d[a])
                    s, e = _merged(start[a:b] - w.first[doc], start[a:b] - w.first[doc] + index.n[win[a:b]])
                    out[0].append(int(ka[lo + doc]))
                    out[1].append(int(kb[lo + doc]))
                    out[2].append(np.stack([s, e], axis=1).astype("<i8").tobytes())
                    out[3].append(sorted({i for x in np.unique(win[a:b]).tolist() for i in index.items[x]}))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["ka", "kb", "runs", "items"])

    got = docs.select(*rows.KEY, "text").mapInArrow(look, "ka long, kb long, runs binary, items array<string>")
    # Repeated rows have equal keys and equal hits: one of them is enough.
    return got.groupBy(*rows.KEY).agg(F.first("runs").alias("runs"), F.first("items").alias("items")).withColumn(
        "block", F.lit(block))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256,
    contaminated, and the hits themselves: ``runs`` (array of word ranges
    [start, end)) and ``items`` (ids as strings, sorted)."""
    base = _documents(docs, id_col, text_col)
    all_windows = rows.stage(blocks(windows_of(items, item_col, item_text, window, shingle), block_bytes), "item-windows")
    n_blocks = (all_windows.agg(F.max("block")).first()[0] or 0) + 1
    hits = None
    for block in range(n_blocks):
        mine = all_windows.where(F.col("block") == block)
        width = F.least("n", F.lit(shingle))
        shingles = mine.select(width.alias("k"), F.explode("shingles").alias("h")).distinct()
        known = {}
        for r in shingles.groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("h")).collect():  # one block
            known[r["k"]] = np.sort(np.array(r["h"], np.int64).view(np.uint64))
        counts = shingle_counts(base, known)
        places = mine.select("text", "n", width.alias("k"), "items", F.posexplode("shingles").alias("place", "h"))
        # The rarest shingle; without the ones that no document has, a window cannot occur.
        rare = (places.join(counts, "h", "left").groupBy("text")
                .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h", "place")).alias("p"),
                     F.first("n").alias("n"), F.first("k").alias("k"), F.first("items").alias("items"))
                .where("p.f > 0"))
        index = Index([(r["text"], r["n"], r["k"], r["p"]["h"], r["p"]["place"], r["items"])
                       for r in rare.collect()])  # one block
        found = _hits_of_block(base, index, block)
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy(*rows.KEY).agg(F.collect_list("runs").alias("runs"), F.flatten(
        F.collect_list("items")).alias("items"))

    def sizes(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi, w in _chunks(batch.column("text")):
                n[lo:hi] = np.diff(w.first)
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), batch.column("id"), pa.array(n)],
                                             ["ka", "kb", "id", "n_words"])

    def finish(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for runs, found in zip(batch.column("runs"), batch.column("items")):
                s = e = np.zeros(0, np.int64)
                if runs.as_py():
                    flat = np.concatenate([np.frombuffer(b, "<i8") for b in runs.as_py()]).reshape(-1, 2)
                    s, e = _merged(flat[:, 0], flat[:, 1])
                names = sorted(set(found.as_py() or []), key=lambda i: i.encode("utf-8"))
                out[0].append(int((e - s).sum()))
                out[1].append(len(names))
                out[2].append(hashlib.sha256(",".join(names).encode("utf-8")).hexdigest())
                out[3].append(bool(len(s)))
                out[4].append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
                out[5].append(names)
            run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(run), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"),
                                              *[pa.array(c, t) for c, t in zip(out, types)]], names_)

    id_type = dict(docs.dtypes)[id_col]
    names_ = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "runs", "items"]
    counted = base.mapInArrow(sizes, f"ka long, kb long, id {id_type}, n_words long")
    return counted.join(merged, list(rows.KEY), "left").select("id", "n_words", "runs", "items").mapInArrow(
        finish, f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, "
                "contaminated boolean, runs array<struct<start: long, end: long>>, items array<string>")
