"""Phrase collocations by direct-address tiling of ranked pair counts.

Texts become chunks of word numbers (at most ``CHUNK`` positions of one
language, cut anywhere; a chunk sees the next ``LONGEST - 1`` positions but
counts only phrases that start inside it).  Every level works alike on a
sequence of ids per chunk, -1 where nothing frequent starts:

1. Count the pairs of neighbouring ids.  Ids are ranks by falling frequency, so
   the (id, id) plane is split into tiles of ``TILE`` x ``TILE`` ids: those of
   frequent ids are filled densely and counted with ``numpy.bincount`` at their
   direct addresses, the others hold few entries and are summed as sorted
   coordinates.  Tasks add their own pairs first; tiles are then summed in two
   levels (salted, whole), streaming over sorted tiles, so that memory holds
   one tile whatever the number of tasks.
2. Pairs with the least count are ranked by frequency: the ids of the next level.
3. Chunks get their next sequence: each sends its distinct pairs, thinned by a
   bit table of fixed size, to the hash part that holds their ids; what a part
   finds comes back as packed rows, one per chunk and part.

A phrase of k + 1 words is the pair of its two overlapping phrases of k words;
both must be frequent, so nothing is lost.  Scores and the containment rule are
joins of the four ranked tables, in exact decimals.

Defined results: null texts are empty; a null language is ``und``; words are
told apart inside a chunk by 64-bit fingerprints and by their text elsewhere;
ties in rank do not change results; repeated rows count as often as they occur;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rows, scan

LONGEST = 4
CHUNK = 1 << 20
TEXT_BYTES = 4 << 20
TILE_BITS = 11
TILE = 1 << TILE_BITS
CELLS = TILE * TILE
DENSE = CELLS // 16  # entries from which a tile is counted at direct addresses
HELD = 1 << 21  # distinct pairs a task adds up before they leave
FILTER_BITS = 1 << 26  # the bit table of frequent pairs, 8 MB
SALTS = 128  # first round of a language's top list

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True


def _sequence(buf: np.ndarray, offsets: np.ndarray):
    """(starts, ends) of the words of a flat chunk, and the sequence of word
    numbers with -1 between pieces."""
    starts, ends, first = scan.runs(~(BREAK | GAP)[buf], offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64)
    seen = np.concatenate([[0], np.cumsum(BREAK[buf])])
    cut = np.zeros(len(starts), bool)
    cut[1:] = seen[starts[1:]] > seen[ends[:-1]]
    cut[first[:-1][first[:-1] < len(starts)]] = True
    out = np.full(len(starts) + int(cut.sum()), -1, np.int64)
    out[np.arange(len(starts)) + np.cumsum(cut)] = np.arange(len(starts))
    return starts, ends, out


def squeeze(ints: np.ndarray) -> bytes:
    """Integers as compressed byte planes of the smallest width that holds them."""
    lo, hi = int(ints.min(initial=0)), int(ints.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= lo and hi < 1 << 8 * w - 1)
    planes = ints.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return width.to_bytes(1, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def expand(data: bytes | pa.Buffer) -> np.ndarray:
    data = memoryview(data)
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64)


CHUNKS = "chunk long, lang string, own int, ids binary"


def chunks_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Chunks with the words they hold (``words``) and how often one starts (``counts``)."""
    def cut(batches):
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang in pc.unique(batch.column(0)):
                buf, off = scan.texts_of(batch.filter(pc.equal(batch.column(0), lang)).column(1))
                for lo, hi in scan.chunks(off, TEXT_BYTES):
                    part = scan.LOWER[buf[off[lo]:off[hi]]]
                    starts, ends, seq = _sequence(part, off[lo:hi + 1] - off[lo])
                    raw, hashes = part.tobytes(), scan.word_hashes(part, starts, ends)
                    for a in range(0, len(seq), CHUNK):
                        piece = seq[a:a + CHUNK + LONGEST - 1]
                        own = min(CHUNK, len(seq) - a)
                        at = np.flatnonzero(piece >= 0)
                        _, first, local = np.unique(hashes[piece[at]], return_index=True, return_inverse=True)
                        ids = np.full(len(piece), -1, np.int64)
                        ids[at] = local
                        counts = np.bincount(local[at < own], minlength=len(first)).astype(np.int64)
                        names = [raw[starts[i]:ends[i]].decode("utf-8") for i in piece[at][first]]
                        if at.size:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([k]), pa.array([lang.as_py()]), pa.array([own], pa.int32()),
                                 pa.array([squeeze(ids)]), pa.array([names]), pa.array([counts])],
                                ["chunk", "lang", "own", "ids", "words", "counts"])
                            k += 1

    flat = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return flat.mapInArrow(cut, f"{CHUNKS}, words array<string>, counts array<long>")


def ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``id``: the rank inside a language by falling ``f`` (from 0, dense).
    Places of a frequency come from the histogram of frequencies; rows of equal
    frequency are numbered by hash buckets."""
    hist = counted.groupBy("lang", "f").agg(F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("lang").orderBy(F.col("f").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = hist.select(F.col("lang").alias("_l"), F.col("f").alias("_f"),
                         F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_s"))
    at = rows.dense_rank_of(counted, ["lang", "f"], [F.col(k) for k in keys], "r")
    return at.join(starts, (F.col("lang") == F.col("_l")) & (F.col("f") == F.col("_f"))).withColumn(
        "id", (F.col("r") + F.col("_s")).cast("long")).drop("r", "_l", "_f", "_s")


# ---------------------------------------------------------------- pair counts

LOW = np.uint64(TILE - 1)
_T, _T2, _T3 = np.uint64(TILE_BITS), np.uint64(2 * TILE_BITS), np.uint64(32 + TILE_BITS)


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of 32-bit ids as numbers in tile order: tile row, tile column, address inside the tile."""
    a, b = (x.astype(np.uint64) & np.uint64(0xFFFFFFFF) for x in (a, b))
    return (a >> _T) << _T3 | (b >> _T) << _T2 | (a & LOW) << _T | (b & LOW)


def _quadrants(a: np.ndarray, b: np.ndarray):
    """(a >> 32, b >> 32, places): ids beyond 32 bits fall into quadrants of their own."""
    if not len(a) or max(a.max(), b.max()) < 1 << 32:
        yield 0, 0, slice(None)
        return
    high = np.stack([a >> 32, b >> 32], axis=1)
    for qa, qb in np.unique(high, axis=0).tolist():
        yield qa, qb, np.flatnonzero((high[:, 0] == qa) & (high[:, 1] == qb))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several lists, ascending, with their counts added."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    code, n = code[order], n[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    return code[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else n.astype(np.int64)


def _pairs(ids: np.ndarray, own: int) -> np.ndarray:
    """Places where a pair of ids starts."""
    return np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (np.arange(len(ids) - 1) < own))


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary value per slice [cut[i], cut[i + 1]) of ``values``."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * width).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if n.max(initial=0) < 1 << 8 * w))


def _entries(row_inner, row_n):
    inner, buf = np.frombuffer(row_inner.as_buffer(), "<i4"), row_n.as_buffer()
    return inner, np.frombuffer(buf, f"<u{buf.size // len(inner)}").astype(np.int64)


class Tile:
    """Counts of one tile: sorted coordinates, or a dense table once it holds many."""

    def __init__(self):
        self.inner: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held, self.table = 0, None

    def add(self, inner: np.ndarray, n: np.ndarray) -> None:
        self.inner.append(inner)
        self.n.append(n)
        self.held += len(inner)
        if self.held > CELLS // 2:
            self._fold()

    def _fold(self) -> None:
        inner, n = np.concatenate(self.inner), np.concatenate(self.n)
        counted = np.bincount(inner, weights=n, minlength=CELLS).astype(np.int64)  # exact below 2**53
        self.table = counted if self.table is None else self.table + counted
        self.inner, self.n, self.held = [], [], 0

    def counts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(inner addresses, counts of at least ``least``)."""
        if self.table is not None or self.held >= DENSE:
            if self.held:
                self._fold()
            inner = np.flatnonzero(self.table >= least)
            return inner, self.table[inner]
        inner, n = np.concatenate(self.inner), np.concatenate(self.n)
        order = np.argsort(inner, kind="stable")
        inner, n = inner[order], n[order]
        at = np.flatnonzero(np.diff(inner, prepend=-1))
        total = np.add.reduceat(n, at)
        keep = total >= least
        return inner[at][keep], total[keep]


def _tiles(batches: Iterator[pa.RecordBatch], keys: int):
    """(key, Tile) for runs of equal keys (the first ``keys`` columns, sorted)."""
    at, tile = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[:keys]]
        for i, key in enumerate(zip(*cols)):
            if key != at:
                if at is not None:
                    yield at, tile
                at, tile = key, Tile()
            tile.add(*_entries(batch.column("inner")[i], batch.column("n")[i]))
    if at is not None:
        yield at, tile


def pair_counts(chunks: DataFrame, least: int) -> DataFrame:
    """(lang, a, b, f): pairs of neighbouring ids that occur ``least`` times or more."""
    tasks = chunks.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    salts = math.isqrt(tasks + 1)

    def emit(key, code, n, salt):
        lang, qa, qb = key
        tile = code >> _T2
        at = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        ta, tb = (tile[at] >> np.uint64(21)).astype(np.int64), (tile[at] & np.uint64((1 << 21) - 1)).astype(np.int64)
        cut = np.append(at, len(code))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(ta + (qa << 21)), pa.array(tb + (qb << 21)),
             pa.array(np.full(len(at), salt, np.int32)), _binary((code & np.uint64(CELLS - 1)).astype("<i4"), cut),
             _binary(_small(n), cut)], ["lang", "ta", "tb", "salt", "inner", "n"])

    def partial(batches):
        salt = TaskContext.get().partitionId() % salts
        held: dict[tuple, list] = {}
        fresh = 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang, own = batch.column("lang")[i].as_py(), batch.column("own")[i].as_py()
                ids = expand(batch.column("ids")[i].as_buffer())
                at = _pairs(ids, own)
                a, b = ids[at], ids[at + 1]
                for qa, qb, some in _quadrants(a, b):
                    code, n = np.unique(_codes(a[some], b[some]), return_counts=True)
                    if len(code):
                        held.setdefault((lang, qa, qb), []).append((code, n.astype(np.uint32)))
                        fresh += len(code)
                if fresh > HELD:
                    held = {key: [_summed(parts)] for key, parts in held.items()}
                    fresh = 0
                    if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                        for key in list(held):
                            yield from emit(key, *held.pop(key)[0], salt)
        for key in list(held):
            yield from emit(key, *_summed(held.pop(key)), salt)

    def add(batches):
        for (lang, ta, tb, _), tile in _tiles(batches, 4):
            inner, n = tile.counts(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([ta]), pa.array([tb]), pa.array([inner.astype("<i4").tobytes()]),
                 pa.array([_small(n).tobytes()])], ["lang", "ta", "tb", "inner", "n"])

    def whole(batches):
        for (lang, ta, tb), tile in _tiles(batches, 3):
            inner, n = tile.counts(least)
            inner = inner.astype(np.int64)
            if len(inner):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(inner)), pa.array((ta << TILE_BITS) + (inner >> TILE_BITS)),
                     pa.array((tb << TILE_BITS) + (inner & (TILE - 1))), pa.array(n)], ["lang", "a", "b", "f"])

    key = ["lang", "ta", "tb"]
    part = chunks.select("lang", "own", "ids").mapInArrow(
        partial, "lang string, ta long, tb long, salt int, inner binary, n binary")
    some = part.repartition(*key, "salt").sortWithinPartitions(*key, "salt").mapInArrow(
        add, "lang string, ta long, tb long, inner binary, n binary")
    return some.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        whole, "lang string, a long, b long, f long")


# ---------------------------------------------------------------- next sequence

def _bits(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = scan.mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(lang.encode("utf-8"))))
    return (scan.mix(mixed ^ b.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def bit_table(pairs: DataFrame) -> np.ndarray:
    """Packed bits, set for every pair; fixed size.  64 slices are made by Spark."""
    width = FILTER_BITS // 64

    def places(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which = np.asarray(langs.indices)
            a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                p = np.unique(_bits(lang, a[which == k], b[which == k]))
                yield pa.RecordBatch.from_arrays([pa.array((p // width).astype(np.int32)),
                                                  pa.array((p % width).astype(np.int32))], ["slice", "p"])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(width, bool)
        bits[np.asarray(table.column("p"))] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits).tobytes()])})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in (pairs.mapInArrow(places, "slice int, p int").distinct()
              .groupBy("slice").applyInArrow(fill, "slice int, bits binary").collect()):  # 64 rows, 8 MB
        out[r["slice"] * width // 8:(r["slice"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _distinct_pairs(ids: np.ndarray):
    """Places of pairs (all of the chunk), the distinct pairs, and each place's number among them."""
    at = _pairs(ids, len(ids))
    a, b = ids[at], ids[at + 1]
    names_a, x = np.unique(a, return_inverse=True)
    names_b, y = np.unique(b, return_inverse=True)
    codes, number = np.unique(x.astype(np.int64) << 32 | y, return_inverse=True)
    return at, names_a[codes >> 32], names_b[codes & 0xFFFFFFFF], number


class PairNames:
    """Ids of the pairs of one part; any 64-bit ids."""

    def __init__(self, found: list[tuple[bytes, np.ndarray]]):
        a, b = (np.concatenate(x) for x in zip(*(self._open(keys) for keys, _ in found)))
        ids = np.concatenate([i for _, i in found])
        self.a, x = np.unique(a, return_inverse=True)
        self.b, y = np.unique(b, return_inverse=True)
        code = x.astype(np.int64) << 32 | y
        order = np.argsort(code)
        self.code, self.ids = code[order], ids[order]

    @staticmethod
    def _open(keys):
        return np.split(expand(keys), 2)

    @staticmethod
    def _at(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        return at, names[at] == values

    def find(self, keys: bytes) -> np.ndarray:
        """Id of every key, -1 where it has none."""
        a, b = self._open(keys)
        (x, fine), (y, too) = self._at(self.a, a), self._at(self.b, b)
        at, same = self._at(self.code, x << 32 | y)
        return np.where(fine & too & same, self.ids[at], -1)


class WordNames:
    """Ids of the words of one part; words never hold a line break."""

    def __init__(self, found: list[tuple[bytes, np.ndarray]]):
        self.ids = {w: i for keys, ids in found for w, i in zip(self._open(keys), ids.tolist())}

    @staticmethod
    def pack(words: list[bytes]) -> bytes:
        raw = b"\n".join(words)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def _open(keys):
        keys = memoryview(keys)
        return pa.decompress(keys[8:], int.from_bytes(keys[:8], "little"), "zstd", asbytes=True).split(b"\n")

    def find(self, keys: bytes) -> np.ndarray:
        return np.array([self.ids.get(w, -1) for w in self._open(keys)], np.int64)


PACKED = "part int, named int, lang string, chunk long, at binary, keys binary"


def _by_part(parts_of: np.ndarray):
    """(part, places of its entries)."""
    order = np.argsort(parts_of, kind="stable")
    cut = np.flatnonzero(np.diff(parts_of[order], prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        yield int(parts_of[order[lo]]), order[lo:hi]


def _row(part: int, named: int, lang: str, chunk: int, at: np.ndarray, keys: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([named], pa.int32()), pa.array([lang]), pa.array([chunk]),
         pa.array([squeeze(at)]), pa.array([keys])], ["part", "named", "lang", "chunk", "at", "keys"])


def _met(names: DataFrame, sent: DataFrame, kind) -> DataFrame:
    """(chunk, at, id) packed: what ``sent`` (PACKED, named = 1, ``at`` the entries'
    numbers) finds among ``names`` (PACKED, named = 0, ``at`` their ids).  A part's
    names come first and are held; chunks stream past them."""
    def meet(batches):
        now, held, known = None, [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "named", "lang", "chunk", "at", "keys")]
            for part, named, lang, chunk, at, keys in zip(*cols):
                if (part, lang) != now:
                    now, held, known = (part, lang), [], None
                if not named:
                    held.append((keys, expand(at)))
                    continue
                if held:
                    known, held = kind(held), []
                if known is None:
                    continue
                ids = known.find(keys)
                hit = ids >= 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([squeeze(expand(at)[hit])]), pa.array([squeeze(ids[hit])])],
                        ["chunk", "at", "id"])

    order = ("part", "lang", "named")
    return names.unionByName(sent).repartition("part").sortWithinPartitions(*order).mapInArrow(
        meet, "chunk long, at binary, id binary")


def _parts(names: DataFrame) -> int:
    """Parts of a lookup: a few per shuffle partition, and no more than about 2**18 names in one."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * n, names.count() >> 18)


def _renamed(chunks: DataFrame, names: DataFrame, number) -> DataFrame:
    """Chunks whose ids are replaced: ``names`` has packed (chunk, at, id), ``number(ids)``
    gives the places, their ``at`` and the number of different ones; places without a name become -1."""
    by_chunk = names.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("names"))

    def rename(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = expand(batch.column("ids")[i].as_buffer())
                place, at, size = number(ids)
                to = np.full(size, -1, np.int64)
                for named in batch.column("names")[i].as_py():
                    to[expand(named["at"])] = expand(named["id"])
                out = np.full(len(ids), -1, np.int64)
                out[place] = to[at]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("chunk", "lang", "own")),
                                                  pa.array([squeeze(out)])], ["chunk", "lang", "own", "ids"])

    return chunks.select("chunk", "lang", "own", "ids").join(by_chunk, "chunk").mapInArrow(rename, CHUNKS)


def with_word_ids(chunks: DataFrame, words: DataFrame) -> DataFrame:
    parts = _parts(words)

    def parts_of(column):
        buf, off = scan.texts_of(column)
        return (scan.word_hashes(buf, off[:-1], off[1:]) % np.uint64(parts)).astype(np.int64)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                column = batch.column("words")[i].values
                text = column.cast(pa.binary()).to_pylist()
                for part, at in _by_part(parts_of(column)):
                    yield _row(part, 1, batch.column("lang")[i].as_py(), batch.column("chunk")[i].as_py(), at,
                               WordNames.pack([text[k] for k in at]))

    def name(batches):
        for batch in batches:
            for lang in pc.unique(batch.column("lang")):
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                text, ids = mine.column("word").cast(pa.binary()).to_pylist(), np.asarray(mine.column("id"))
                for part, at in _by_part(parts_of(mine.column("word"))):
                    yield _row(part, 0, lang.as_py(), 0, ids[at], WordNames.pack([text[k] for k in at]))

    def number(ids):
        place = np.flatnonzero(ids >= 0)
        return place, ids[place], int(ids.max(initial=-1)) + 1

    names = words.select("lang", "word", "id").mapInArrow(name, PACKED)
    sent = chunks.select("chunk", "lang", "words").mapInArrow(send, PACKED)
    return _renamed(chunks, _met(names, sent, WordNames), number)


def with_pair_ids(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    bits = chunks.sparkSession.sparkContext.broadcast(bit_table(pairs.select("lang", "a", "b")))
    parts = _parts(pairs)

    def send(batches):
        table = bits.value
        for batch in batches:
            for i in range(batch.num_rows):
                lang, chunk = batch.column("lang")[i].as_py(), batch.column("chunk")[i].as_py()
                _, a, b, _ = _distinct_pairs(expand(batch.column("ids")[i].as_buffer()))
                p = _bits(lang, a, b)
                go = np.flatnonzero(table[p >> 3] >> (7 - (p & 7)) & 1)
                for part, some in _by_part(p[go] % parts):
                    at = go[some]
                    yield _row(part, 1, lang, chunk, at, squeeze(np.concatenate([a[at], b[at]])))

    def name(batches):
        for batch in batches:
            for lang in pc.unique(batch.column("lang")):
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                a, b, ids = (np.asarray(mine.column(c)) for c in ("a", "b", "id"))
                for part, at in _by_part(_bits(lang.as_py(), a, b) % parts):
                    yield _row(part, 0, lang.as_py(), 0, ids[at], squeeze(np.concatenate([a[at], b[at]])))

    def number(ids):
        place, a, _, at = _distinct_pairs(ids)
        return place, at, len(a)

    names = pairs.select("lang", "a", "b", "id").mapInArrow(name, PACKED)
    sent = chunks.select("chunk", "lang", "ids").mapInArrow(send, PACKED)
    return _renamed(chunks, _met(names, sent, PairNames), number)


# ---------------------------------------------------------------- scores

def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _scored(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut (the smallest on ties)."""
    made = []
    for k, (left, right) in enumerate(cuts, 1):
        with_sum = {"a": "f", "l": left, "r": right}
        score = F.expr("cast(cast({a} as decimal(20,0)) * 2000000 div (cast({l} as decimal(20,0)) + "
                       "cast({r} as decimal(20,0))) as bigint)".format(**with_sum))
        made.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    return phrases.withColumn("best", F.array_min(F.array(*made)))


def _longer(longer: DataFrame) -> DataFrame:
    """(lang, id, longest): the highest count of a phrase that holds phrase ``id`` at either end."""
    either = longer.select("lang", F.explode(F.array("a", "b")).alias("id"), "f")
    return either.groupBy("lang", "id").agg(F.max("f").alias("longest"))


def _free(phrases: DataFrame, longer: DataFrame | None, part: int = 80) -> DataFrame:
    """Phrases that no longer one explains.  One word more is enough: a still
    longer phrase is no more frequent than the one inside it that holds the phrase."""
    out = phrases
    if longer is not None:
        out = out.join(_longer(longer), ["lang", "id"], "left").where(
            F.col("longest").isNull() | (_big("longest") * 100 < _big("f") * part))
    return out.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of all candidates that no longer one explains,
    and (lang, n)."""
    chunks = rows.stage(chunks_of(docs, lang_col, text_col), "phrase-chunks")
    pair = F.explode(F.arrays_zip("words", "counts")).alias("p")
    counted = chunks.select("lang", pair).groupBy("lang", F.col("p.words").alias("word")).agg(F.sum("p.counts").alias("f"))
    total = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("c")).groupBy(
        "lang").agg(F.sum("c").alias("n"))
    total = rows.stage(total, "phrase-totals")
    words = rows.stage(ranked(rows.stage(counted.where(F.col("f") >= least), "phrase-words"), ["word"]), "phrase-word-ids")

    level = rows.stage(with_word_ids(chunks, words), "phrase-level-1")
    rows.discard(chunks)
    known = []
    for size in range(2, LONGEST + 1):
        found = rows.stage(pair_counts(level, least), f"phrase-pairs-{size}")
        if size < LONGEST:
            found = rows.stage(ranked(found, ["a", "b"]), f"phrase-ids-{size}")
            last, level = level, rows.stage(with_pair_ids(level, found), f"phrase-level-{size}")
            rows.discard(last)
        known.append(found)
    rows.discard(level)

    def both(pairs: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
        side = [names.select("lang", F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "ab"]
        return pairs.join(side[0], ["lang", "a"]).join(side[1], ["lang", "b"])

    two = both(known[0], words, ["word", "f"]).select(
        "lang", "id", "a", "b", "f", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("b_word").alias("last"),
        F.col("a_f").alias("first_f"), F.col("b_f").alias("last_f"))
    two = rows.stage(_scored(two, [("first_f", "last_f")]), "phrase-two")
    three = both(known[1], two, ["phrase", "last", "f", "first_f", "last_f"]).select(
        "lang", "id", "a", "b", "f", F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"),
        F.col("a_first_f").alias("first_f"), F.col("b_last_f").alias("last_f"), F.col("a_f").alias("head_f"),
        F.col("b_f").alias("tail_f"))
    three = rows.stage(_scored(three, [("first_f", "tail_f"), ("head_f", "last_f")]), "phrase-three")
    four = both(known[2], three, ["phrase", "last", "f", "first_f", "last_f", "head_f", "tail_f"]).select(
        "lang", "a", "b", "f", F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), "a_first_f", "a_head_f", "a_f",
        "b_f", "b_tail_f", "b_last_f")
    four = _scored(four, [("a_first_f", "b_f"), ("a_head_f", "b_tail_f"), ("a_f", "b_last_f")])
    return _free(two, three).unionByName(_free(three, known[2])).unionByName(_free(four, None)), total


def top_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30,
                top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, total = phrases(docs, lang_col, text_col, least)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           "n", "score")
