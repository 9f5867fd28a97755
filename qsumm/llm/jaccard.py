"""N-gram Jaccard join with count-vector R-trees.

Two documents link when the Jaccard similarity of their sets of 5-word shingles
is 75 percent or more (exact on 64-bit shingle hashes).

1. Documents with equal sets are one class; only its smallest member goes on.
2. Linked sets share at least a quarter of their size (``shared_least``) among
   their rarest halves (``prefix_length``) in any global order.  The first order
   is by a count sketch of all shingles, rare first: a passage that many documents
   share leaves the prefixes.  Prefix shingles meet in a packed exchange, where
   the exact number of classes that hold one becomes known.  A class with fewer
   shared prefix shingles than a link needs is alone; of the others only the
   rarest shared ones, by that exact number, travel again, and classes that
   share one are chained to a block (connected components).  So blocks do not
   grow together with the corpus, however little the sketch tells apart.
3. Inside a block, tokens (shingles) are hashed into groups; the counts per
   group make a point.  An R-tree over the points holds, per node, the largest
   count of every coordinate and the smallest size: the sum of coordinate
   minima bounds the overlap with every set below the node.  Pairs that survive
   the bound are verified on the sets.  Sets that already are in one component
   need no further check, so a group of near copies costs one link per member.
4. Blocks beyond ``BLOCK_BYTES`` are split into tiles by set size; every pair of
   tiles whose sizes can link is searched in a task of its own, and the links
   of all tiles are joined to components.

Defined results: null and empty texts have an empty set, link with nothing and
are their own component; a text of fewer than five words has its whole word
sequence as its only shingle; repeated rows are one component; an empty table
gives an empty result; null ids take part, the component of a group is its
smallest non-null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fingerprints, rows, scan

SHINGLE = 5
PERCENT = 75
SKETCH_CELLS = 1 << 22  # counters of the frequency sketch; bounds its broadcast
SLICE = 1 << 14
GROUPS = 128
FANOUT = 16
BLOCK_BYTES = 24 << 20  # text bytes of a block that one task takes whole
TILE_BYTES = 16 << 20


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every document, offsets)."""
    low = scan.LOWER[buf]
    starts, ends, first = scan.words(buf, offsets)
    docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    sums = [scan.prefix(scan.word_hashes(low, starts, ends, w), w + 2) for w in (0, 1)]

    def hashed(lo, hi):
        a, b = (scan.range_hash(sums[w], lo, hi, w + 2) for w in (0, 1))
        return scan.mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ (hi - lo).astype(np.uint64))

    n = np.diff(first)
    owner = scan.owner(first)
    place = np.arange(len(starts)) - first[owner]
    lo = np.flatnonzero((place + SHINGLE <= n[owner]) | ((place == 0) & (n[owner] < SHINGLE)))
    hi = np.minimum(lo + SHINGLE, first[owner[lo] + 1])
    h, d = hashed(lo, hi), owner[lo]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(docs + 1))


def shared_least(n):
    """Prefix shingles that a set of ``n`` has in common with the prefix of any linked set, at least.

    Linked sets overlap in ``least`` = 75 percent of the larger one.  Of two prefixes the one that
    ends first in the order lacks at most the rest of its set, ``n - prefix_length(n)``.  That rest
    and this number both grow with ``n``, so the bound holds whichever ends first."""
    least = -(-n * PERCENT // 100)
    return least // 3 + 1


def prefix_length(n):
    """Shingles of a set of ``n`` that travel: the rarest half, about."""
    return n - -(-n * PERCENT // 100) + shared_least(n)


def class_numbers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number per set: a hash of its size and of two order-free sums over its members."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(scan.mix(h + np.uint64(c)), dtype=np.uint64)])
            for c in (0x51ED27, 0x2545F491)]
    fa, fb = (s[at[1:]] - s[at[:-1]] for s in sums)
    return scan.mix(fa ^ scan.mix(fb + np.diff(at).astype(np.uint64))).view(np.int64)


def classes(base: DataFrame) -> DataFrame:
    """ka, kb, id, n (set size) and c (class of equal sets) of every document."""
    def run(batches):
        for batch in batches:
            buf, off = scan.texts_of(batch.column(2))
            for lo, hi in scan.chunks(off):
                h, at = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in (batch.column(0), batch.column(1), batch.column(3))],
                     pa.array(np.diff(at)), pa.array(class_numbers(h, at))], ["ka", "kb", "id", "n", "c"])

    id_type = dict(base.dtypes)["id"]
    return base.select(*rows.KEY, "text", "id").mapInArrow(run, f"ka long, kb long, id {id_type}, n long, c long")


SLICES = "slice int, counts binary"


def sketch(texts: DataFrame) -> np.ndarray:
    """How often shingles of every cell occur, over all documents (log scale).

    Every task counts into ``SKETCH_CELLS`` cells (one byte each, as a task needs
    no more to tell frequent from rare) and Spark adds the slices.  Any order of
    the shingles is right; this one only keeps frequent ones out of the prefixes."""
    def count(batches):
        total = np.zeros(SKETCH_CELLS, np.int64)
        for batch in batches:
            buf, off = scan.texts_of(batch.column(0))
            for lo, hi in scan.chunks(off):
                h, _ = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                total += np.bincount((h & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), minlength=SKETCH_CELLS)
        parts = [(s // SLICE, np.minimum(total[s:s + SLICE], 255).astype(np.uint8).tobytes()) for s in range(0, SKETCH_CELLS, SLICE)
                 if total[s:s + SLICE].any()]
        for s, b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([b], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.uint8).astype(np.int64) for b in table.column("counts").to_pylist())
        level = np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8)  # eighths of a doubling
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([level.tobytes()], pa.binary())})

    return gathered(texts.select("text").mapInArrow(count, SLICES).groupBy("slice").applyInArrow(add, SLICES))


def gathered(slices: DataFrame) -> np.ndarray:
    """One table from its slices: SKETCH_CELLS bytes reach the driver, whatever the corpus."""
    out = np.zeros(SKETCH_CELLS, np.uint8)
    for r in slices.collect():
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint8)
    return out


def _bit(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of class numbers in a table of SKETCH_CELLS bytes."""
    cell = scan.mix(c.astype(np.int64).view(np.uint64)) & np.uint64(8 * SKETCH_CELLS - 1)
    return (cell >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (cell & np.uint64(7)).astype(np.uint8))


def marks(numbers: DataFrame) -> np.ndarray:
    """A table of bits in which those of all ``numbers`` (one column of class numbers) are set."""
    def mark(batches):
        total = np.zeros(SKETCH_CELLS, np.uint8)
        for batch in batches:
            np.bitwise_or.at(total, *_bit(np.asarray(batch.column(0))))
        for s in range(0, SKETCH_CELLS, SLICE):
            if total[s:s + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([s // SLICE], pa.int32()),
                                                  pa.array([total[s:s + SLICE].tobytes()], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.uint8)
        for b in table.column("counts").to_pylist():
            total |= np.frombuffer(b, np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return gathered(numbers.mapInArrow(mark, SLICES).groupBy("slice").applyInArrow(add, SLICES))


def marked(texts: DataFrame, bits) -> DataFrame:
    """Rows of ``texts`` (c first) whose bit is set: all whose number is in ``marks`` and few others,
    so that a join with those numbers moves little text."""
    def pick(batches):
        for batch in batches:
            at, bit = _bit(np.asarray(batch.column(0)))
            yield batch.filter(pa.array((bits.value[at] & bit) != 0))

    return texts.mapInArrow(pick, texts.schema)


def prefix_entries(buf: np.ndarray, offsets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document number) of all prefix shingles: the rarest by (level, hash)."""
    h, at = shingle_sets(buf, offsets)
    doc, n = scan.owner(at), np.diff(at)
    order = np.lexsort((h, level[(h & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)], doc))
    pick = np.arange(len(h)) - at[doc] < prefix_length(n)[doc]
    return h[order][pick], doc[pick]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, one byte of all of them after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


# A shingle travels as its part and 40 other bits of its hash; a document by its number in its chunk.
FP_BYTES, DOC_BYTES, COUNT_BYTES = 5, 3, 2
SHINGLES = "part int, chunk long, fps binary, docs binary, own boolean"
SHARED = "chunk long, part int, fps binary, docs binary, counts binary, own boolean"


def shared(texts: DataFrame, level, parts: int) -> DataFrame:
    """Prefix shingles that two classes or more hold, with the number of those classes, packed
    per chunk and part.  ``texts``: c, n and one text of every class; a chunk is named after its
    first class, and its classes and sizes (``own``) ride along through any part."""
    def pack(batches):
        for batch in batches:
            c, n = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            buf, off = scan.texts_of(batch.column(2))
            for lo, hi in scan.chunks(off, fingerprints.PACK_BYTES):
                sub = off[lo:hi + 1] - off[lo]
                held = []
                for x, y in scan.chunks(sub):
                    fp, doc = prefix_entries(buf[off[lo] + sub[x]:off[lo] + sub[y]], sub[x:y + 1] - sub[x], level.value)
                    held.append((fp, doc + x))
                fp, doc = (np.concatenate(x) for x in zip(*held))
                part = ((fp >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")  # by document inside: their numbers compress well
                fp, doc, cut = fp[by], doc[by], np.searchsorted(part[by], np.arange(parts + 1))
                out = [(int(i), planes(fp[cut[i]:cut[i + 1]], FP_BYTES), planes(doc[cut[i]:cut[i + 1]], DOC_BYTES), False)
                       for i in np.flatnonzero(np.diff(cut))]
                out.append((int(c[lo] % parts), c[lo:hi].astype("<i8").tobytes(), n[lo:hi].astype("<i4").tobytes(), True))
                part, fps, docs, own = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([int(c[lo])] * len(out), pa.int64()),
                     pa.array(fps, pa.binary()), pa.array(docs, pa.binary()), pa.array(own, pa.bool_())],
                    ["part", "chunk", "fps", "docs", "own"])

    def meet(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        held = table.column("fps").to_pylist()
        fps = [np.zeros(0, np.uint64) if o else from_planes(b, FP_BYTES) for o, b in zip(own, held)]
        every = np.concatenate(fps)
        _, at, size = np.unique(every, return_inverse=True, return_counts=True)
        count = np.minimum(size, (1 << 8 * COUNT_BYTES) - 1)[at]
        first = np.concatenate([[0], np.cumsum([len(f) for f in fps])]).astype(np.int64)
        out = []
        for i, (chunk, part, docs) in enumerate(zip(*(table.column(x).to_pylist() for x in ("chunk", "part", "docs")))):
            if own[i]:
                out.append((chunk, part, held[i], docs, b"", True))
                continue
            k = count[first[i]:first[i + 1]]
            many = k > 1
            if many.any():
                out.append((chunk, part, planes(fps[i][many], FP_BYTES), planes(from_planes(docs, DOC_BYTES)[many], DOC_BYTES),
                            planes(k[many], COUNT_BYTES), False))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.bool_()]
        cols = zip(*out) if out else [[]] * len(types)
        return pa.table([pa.array(x, t) for x, t in zip(cols, types)], ["chunk", "part", "fps", "docs", "counts", "own"])

    return (texts.select("c", "n", "text").mapInArrow(pack, SHINGLES)
            .groupBy("part").applyInArrow(meet, SHARED))


def rarest_shared(doc: np.ndarray, fp: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the entries that a link needs.  ``doc``, ``fp``, ``count``: shared prefix shingles of
    sets of ``n``.  A linked set has ``shared_least`` of them; all but that number less one, in the order
    of (count, shingle), hold one of these.  A set with fewer is alone."""
    order = np.lexsort((fp, count, doc))
    have = np.bincount(doc, minlength=len(n))
    rank = np.arange(len(doc)) - (np.cumsum(have) - have)[doc[order]]
    return order[rank < (have - shared_least(n) + 1)[doc[order]]]


def size_level(n: np.ndarray) -> np.ndarray:
    """Sizes of linked sets are in one level or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100.0 / PERCENT)).astype(np.int64)


def chained(fp: np.ndarray, c: np.ndarray, n: np.ndarray):
    """Entries as groups of one shingle and size level, sorted by size inside:
    (order, first of each group, last of each group, star edges a, b)."""
    level = size_level(n)
    order = np.lexsort((c, n, level, fp))
    f, l_, k = fp[order], level[order], c[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (l_[1:] != l_[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(f)) - 1
    a = k[np.repeat(first, last - first + 1)]
    other = a != k
    return order, first, last, *_distinct(a[other], k[other])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undirected pairs, each once."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


PREFIXES = "part int, fps binary, classes binary, sizes binary, own boolean"


def chains(texts: DataFrame, level, parts: int) -> DataFrame:
    """Edges (a, b) between classes that share one of their rarest shared prefix
    shingles: inside a size level all to the smallest, and between neighbouring
    levels that are near enough.

    A task folds its chunk first: of the entries of one shingle and level only
    the smallest and the largest set travel, so a shingle that a third of all
    documents share costs two entries per chunk and level."""
    def pack(table: pa.Table) -> pa.Table:
        held = table.select(["part", "fps", "docs", "counts", "own"]).to_pylist()
        classes, sizes = next((np.frombuffer(r["fps"], "<i8"), np.frombuffer(r["docs"], "<i4")) for r in held if r["own"])
        held = [r for r in held if not r["own"]]
        fp = np.concatenate([from_planes(r["fps"], FP_BYTES) | np.uint64(r["part"] << 8 * FP_BYTES) for r in held]
                            + [np.zeros(0, np.uint64)])
        doc, count = (np.concatenate([from_planes(r[x], w) for r in held] + [np.zeros(0, np.uint64)]).astype(np.int64)
                      for x, w in (("docs", DOC_BYTES), ("counts", COUNT_BYTES)))
        go = rarest_shared(doc, fp, count, sizes.astype(np.int64))
        fp, c, n = fp[go], classes[doc[go]], sizes[doc[go]].astype(np.int64)
        out = []
        if len(fp):
            order, first, last, ea, eb = chained(fp, c, n)
            ends = c[order[first]] != c[order[last]]
            go = order[np.concatenate([first, last[ends]])]
            part = (fp[go] >> np.uint64(8 * FP_BYTES)).astype(np.int64)
            by = np.lexsort((c[go], n[go], part))
            go, part = go[by], part[by]
            cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            out = [(int(part[x]), fp[k].astype("<u8").tobytes(), c[k].astype("<i8").tobytes(), n[k].astype("<i4").tobytes(), False)
                   for x, y in zip(cut[:-1], cut[1:]) for k in (go[x:y],)]
            if len(ea):  # edges ride along to any part
                out.append((out[0][0], ea.astype("<i8").tobytes(), eb.astype("<i8").tobytes(), b"", True))
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        cols = zip(*out) if out else [[]] * len(types)
        return pa.table([pa.array(x, t) for x, t in zip(cols, types)], ["part", "fps", "classes", "sizes", "own"])

    def meet(table: pa.Table) -> pa.Table:
        held = table.select(["fps", "classes", "sizes", "own"]).to_pylist()
        edges = [(np.frombuffer(r["fps"], "<i8"), np.frombuffer(r["classes"], "<i8")) for r in held if r["own"]]
        fp, c, n = (np.concatenate([np.frombuffer(r[x], t) for r in held if not r["own"]] + [np.zeros(0, t)])
                    for x, t in (("fps", "<u8"), ("classes", "<i8"), ("sizes", "<i4")))
        if len(fp):
            order, first, last, ea, eb = chained(fp, c, n)
            edges.append((ea, eb))
            f, small, large, k = fp[order[first]], n[order[first]], n[order[last]], c[order[first]]
            step = size_level(small)
            near = ((f[1:] == f[:-1]) & (step[1:] == step[:-1] + 1) & (k[1:] != k[:-1])
                    & (small[1:].astype(np.int64) * PERCENT <= large[:-1].astype(np.int64) * 100))
            edges.append((k[:-1][near], k[1:][near]))
        a, b = _distinct(*(np.concatenate(x) for x in zip(*edges)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (shared(texts, level, parts).groupBy("chunk").applyInArrow(pack, PREFIXES)
            .groupBy("part").applyInArrow(meet, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable.  Every round points each node at
    its smallest neighbour, jumps along the pointers, and contracts the graph to
    the nodes pointed at: rounds shrink, so all of them together cost about two.
    The maps of the rounds are composed from the last (smallest) one back."""
    edges = rows.stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                       "edges")
    maps = []
    while not maps or edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = rows.stage(both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
        for _ in range(2):  # pointers only fall, so a jump never meets a circle
            up = rows.stage(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
                            .select("node", F.col("next").alias("root")), "pointers")
        maps.append(up)
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
        edges = edges.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        edges = rows.stage(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    label = maps.pop()
    while maps:
        later = label.select(F.col("node").alias("root"), F.col("root").alias("last"))
        label = rows.stage(maps.pop().join(later, "root", "left")
                           .select("node", F.coalesce("last", "root").alias("root")), "labels")
    return label


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(i)) for i in at], np.int64)


def points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Counts of every set's shingles per hash group."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    g = ((h >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(at * groups + g, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


class RTree:
    """Packed R-tree over count vectors: per node the coordinate maxima and the
    smallest and largest set size below it."""

    def __init__(self, p: np.ndarray, sizes: np.ndarray):
        # Packing order: by size, ties by the first coordinates, so near sets share leaves.
        self.order = np.lexsort((*p.T[:4][::-1], sizes))
        self.levels = [(p[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            hi, small, large = self.levels[-1]
            cut = np.arange(0, len(small), FANOUT)
            self.levels.append((np.maximum.reduceat(hi, cut, axis=0), np.minimum.reduceat(small, cut),
                                np.maximum.reduceat(large, cut)))

    def candidates(self, q: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the sets whose overlap bound allows a link with the query."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, small, large = self.levels[depth]
            ok = (small[at] * PERCENT <= size * 100) & (large[at] * 100 >= size * PERCENT)
            at = at[ok]
            least = np.maximum(small[at], -(-size * PERCENT // 100))
            # A link needs overlap >= p / (100 + p) of both sizes together.
            bound = np.minimum(hi[at], q).sum(1)
            at = at[bound * (100 + PERCENT) >= PERCENT * (size + least)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard test of two sorted sets."""
    least = -(-PERCENT * (len(a) + len(b)) // (100 + PERCENT))
    if min(len(a), len(b)) < least:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def search(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the linked sets to components (a spanning forest).  With
    ``side`` (0 or 1 per set) only pairs across the sides are tested."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    groups = int(min(1024, max(GROUPS, 1 << int(np.median(sizes) // 4).bit_length()))) if n else GROUPS
    if n * groups > 1 << 25:  # keeps the points of a block below 128 MB
        groups = GROUPS
    p = points(sets, groups)
    forest, links = Forest(n), []
    indexed = np.arange(n) if side is None else np.flatnonzero(side == 1)
    asking = np.arange(n) if side is None else np.flatnonzero(side == 0)
    if not len(indexed):
        return links
    tree = RTree(p[indexed], sizes[indexed])
    for i in asking[np.argsort(sizes[asking], kind="stable")].tolist():
        near = indexed[tree.candidates(p[i], int(sizes[i]))]
        if side is None:
            near = near[near < i]
        if not len(near):
            continue
        roots = forest.roots(near)
        own = forest.find(i)
        near, roots = near[roots != own], roots[roots != own]
        # Likely partners first: the largest bounds; one link settles a whole component.
        bound = np.minimum(p[near], p[i]).sum(1) / np.maximum(sizes[near] + sizes[i], 1)
        done: set[int] = set()
        for k in np.argsort(-bound, kind="stable").tolist():
            r = int(roots[k])
            if r in done:
                continue
            j = int(near[k])
            if linked(sets[i], sets[j]):
                done.add(r)
                forest.join(i, j)
                links.append((i, j))
    return links


def _sets(table: pa.Table) -> list[np.ndarray]:
    buf, off = scan.texts_of(table.column("text"))
    out = []
    for lo, hi in scan.chunks(off):
        h, at = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        out += [h[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def _links(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    c = np.asarray(table.column("c"))
    a, b = (c[[p[i] for p in pairs]] if pairs else np.zeros(0, np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def block_links(members: DataFrame, block_bytes: int = BLOCK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Links inside blocks.  ``members``: block, c (class number), n, text."""
    size = members.groupBy("block").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    big = rows.stage(size.where(F.col("bytes") > block_bytes), "jaccard-big")

    def whole(table: pa.Table) -> pa.Table:
        return _links(table, search(_sets(table)))

    small = members.join(big, "block", "left_anti").select("block", "c", "text")
    links = small.groupBy("block").applyInArrow(whole, "a long, b long")
    if not big.take(1):
        return links
    # Tiles of a big block: size levels (linked sets are at most one apart), each cut by hash into bounded parts.
    m = members.join(big, "block").withColumn("level", F.floor(F.log(F.col("n").cast("double")) / np.log(100.0 / PERCENT)))
    per = m.groupBy("block", "level").agg(F.ceil(F.sum(F.octet_length("text") + 64) / tile_bytes).alias("cuts"),
                                          F.min("n").alias("small"), F.max("n").alias("large"))
    per = rows.stage(per, "jaccard-tiles")
    m = m.join(per, ["block", "level"]).withColumn("cut", F.pmod(F.xxhash64("c"), F.col("cuts")))
    tiles = per.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    x, y = tiles.alias("x"), tiles.alias("y")
    # Pairs of tiles (not of documents) that sizes allow; the tile list is as short as bytes / tile_bytes.
    pairs = (x.join(y, F.col("x.block") == F.col("y.block"))
             .where((F.col("x.level") + 1 == F.col("y.level"))
                    | ((F.col("x.level") == F.col("y.level")) & (F.col("x.cut") <= F.col("y.cut"))))
             .where(F.col("y.small") * PERCENT <= F.col("x.large") * 100)
             .select("x.block", F.col("x.level").alias("l0"), F.col("x.cut").alias("c0"),
                     F.col("y.level").alias("l1"), F.col("y.cut").alias("c1")))
    pairs = pairs.withColumn("pair", F.xxhash64("block", "l0", "c0", "l1", "c1")).withColumn("alone", F.expr("l0 = l1 and c0 = c1"))
    ends = (pairs.select("pair", "block", F.col("l0").alias("level"), F.col("c0").alias("cut"), F.lit(0).alias("side"), "alone")
            .unionByName(pairs.where("not alone").select(
                "pair", "block", F.col("l1").alias("level"), F.col("c1").alias("cut"), F.lit(1).alias("side"), "alone")))
    # A tile is searched in itself by the first of its pairs; a task of its own has only a tile without a partner.
    tile = W.partitionBy("block", "level", "cut")
    host = F.min(F.when(~F.col("alone"), F.col("pair"))).over(tile)
    ends = (ends.withColumn("host", host).where(~F.col("alone") | F.col("host").isNull())
            .withColumn("inner", F.col("alone") | (F.col("pair") == F.col("host"))))
    ends = rows.stage(ends.select("pair", "block", "level", "cut", "side", "inner"), "jaccard-pairs")
    dealt = m.join(ends, ["block", "level", "cut"]).select("pair", "side", "inner", "c", "text")

    def across(table: pa.Table) -> pa.Table:
        side, inner = np.asarray(table.column("side")), np.asarray(table.column("inner"))
        sets, pairs = _sets(table), []
        for s in (0, 1):
            own = np.flatnonzero((side == s) & inner)
            if len(own):
                pairs += [(int(own[i]), int(own[j])) for i, j in search([sets[k] for k in own])]
        if side.any() and not side.all():
            pairs += search(sets, side)
        return _links(table, pairs)

    return links.unionByName(dealt.groupBy("pair").applyInArrow(across, "a long, b long"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per document: ``id`` (its id), ``n_shingles``, ``component_id``
    (smallest id of its component), ``component`` (a number of the component, null
    without shingles) and the row key (ka, kb)."""
    base = rows.keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    base = base.select(*rows.KEY, "text", "id")
    # 1. classes of equal sets; a class is numbered by a hash of its fingerprint
    every = rows.stage(classes(base), "jaccard-docs")
    reps = rows.stage(every.where("n > 0").groupBy("c").agg(
        F.min(F.struct("ka", "kb")).alias("k"), F.max("n").alias("n"), F.min("id").alias("least")), "jaccard-classes")
    # One text of every class: equal sets go no further.  Repeated rows share a key and are folded before the exchange.
    one = base.groupBy(*rows.KEY).agg(F.first("text").alias("text"))
    named = reps.select("c", "n", F.col("k.ka").alias("ka"), F.col("k.kb").alias("kb"))
    texts = rows.stage(one.join(named, list(rows.KEY)).select("c", "n", "text"), "jaccard-texts")
    # 2. blocks of classes that share a prefix shingle
    level = docs.sparkSession.sparkContext.broadcast(sketch(texts))
    blocks = components(chains(texts, level, fingerprints.parts_for(docs)))
    bits = docs.sparkSession.sparkContext.broadcast(marks(blocks.select("node")))
    members = rows.stage(marked(texts, bits).join(blocks.select(F.col("node").alias("c"), F.col("root").alias("block")), "c")
                         .select("block", "c", "n", "text"), "jaccard-members")
    rows.discard(texts)
    # 3. links, 4. components
    links = rows.stage(block_links(members, block_bytes, tile_bytes), "jaccard-links")
    rows.discard(members)
    roots = components(links)
    least = (reps.join(roots, reps["c"] == roots["node"], "left")
             .select("c", F.coalesce("root", "c").alias("root"), "least"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(named, "root").select(F.col("c").alias("cc"), F.col("root").alias("component"), "component_id")
    return (every.join(of, every["c"] == of["cc"], "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("component")).alias("component"), *rows.KEY))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns of ``docs``: of every component one row
    (smallest id, nulls last, then smallest row key), of documents without words
    every distinct row."""
    found = rows.stage(cluster(docs, id_col, text_col), "jaccard-clusters")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), *rows.KEY)).alias("r")
    kept = (found.where("component is not null").groupBy("component").agg(first).select("r.ka", "r.kb")
            .unionByName(found.where("component is null").select(*rows.KEY).distinct()))
    plain, names = rows.hidden(docs)
    keyed = rows.keyed(plain, names[id_col], names[text_col])
    one = keyed.join(kept, list(rows.KEY), "left_semi").dropDuplicates(list(rows.KEY))
    return rows.shown(one, names)
