"""Best-fit packing of tokenized documents after Martello-Toth reduction.

Texts are cut into token pieces inside the tasks; only a piece's length and
checksum leave them.  Packing works on the histogram of piece lengths, which
has at most ``capacity`` rows whatever the corpus: pieces of one length are
interchangeable.  ``reduce_dominant`` fixes sets that dominate every other set
holding the same longest piece, in bulk over equal lengths; ``best_fit`` packs
the rest, longest first, each into the fullest bin that takes it.  Both give
patterns with multiplicities.  Pieces then get a hash rank inside their length
(no group is gathered) and look up pattern, bin and offset in the slot table,
whose size is bounded by the capacity as well.

Defined results: null and empty texts are one piece holding only the end id;
longer documents are cut at the capacity and only their last piece may be
shorter; repeated rows are packed as often as they occur; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows, scan

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 1 << 20  # word memo of one Python worker; emptied when full


class WordEncoder:
    """Ids of whole texts from a word-level memo.

    The tokenizer drops white space and never joins across it, so a text's ids
    are the ids of its words; each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.hashes) + len(hashes) > MEMO_WORDS:
            self._clear()
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in batch(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.pool) + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        self.pool = np.concatenate([self.pool, flat])
        where = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.n = np.insert(self.n, where, n)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets per document) of a flat chunk."""
        starts, ends, first = scan.words(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = scan.word_hashes(buf, starts, ends)
        distinct, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct
        if new.any():
            raw = buf.tobytes()
            if len(self.hashes) + int(new.sum()) > MEMO_WORDS:
                self._clear()
                new[:] = True
            ex = example[new]
            self._learn(distinct[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[ex].tolist(), ends[ex].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        n, src = self.n[at][inverse], self.at[at][inverse]
        run = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(run[-1]) - np.repeat(run[:-1] - src, n)
        return self.pool[take], run[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and a row key
    (ka, kb); with ``with_ids`` also the ids themselves (array<int>)."""
    source = rows.keyed(docs, id_col, text_col).select(id_col, *rows.KEY, text_col)
    key_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {key_type}, ka long, kb long, piece int, start long, length long, ids_crc32 long"
    names = [id_col, "ka", "kb", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]

    def cut(batches):
        words = encoder(path or tokenizer_path())
        for batch in batches:
            buf, off = scan.texts_of(batch.column(3))
            for lo, hi in scan.chunks(off):
                ids, at = words.encode(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                n = np.diff(at) + 1
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                crc, held = np.zeros(len(doc), np.int64), []
                end = np.array([end_id], np.uint32)
                for i, (d, s, k) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                    got = ids[at[d] + s:min(at[d] + s + k, at[d + 1])]
                    if len(got) < k:
                        got = np.concatenate([got, end])
                    crc[i] = zlib.crc32(got.astype("<u4").tobytes())
                    if with_ids:
                        held.append(got.astype(np.int32))
                part = batch.slice(lo, hi - lo).take(pa.array(doc))
                cols = [part.column(0), part.column(1), part.column(2), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc)]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(cut, schema)


class Stock:
    """Remaining pieces by length, with the neighbours the reduction asks for."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.lengths = sorted(counts)

    def _gone(self, length: int) -> None:
        if self.n[length] == 0:
            del self.n[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def take(self, items: list[int], times: int) -> None:
        for x in items:
            self.n[x] -= times
        for x in set(items):
            self._gone(x)

    def largest_upto(self, room: int, used: dict[int, int]) -> int:
        """Longest length <= room with a piece not yet in ``used``; 0 if none."""
        i = bisect.bisect_right(self.lengths, room) - 1
        while i >= 0:
            x = self.lengths[i]
            if self.n[x] > used.get(x, 0):
                return x
            i -= 1
        return 0

    def smallest(self, k: int, used: dict[int, int]) -> list[int]:
        """The k shortest pieces not in ``used``."""
        out: list[int] = []
        for x in self.lengths:
            left = self.n[x] - used.get(x, 0)
            out += [x] * min(left, k - len(out))
            if len(out) == k:
                break
        return out


def _bulk(stock: Stock, items: list[int]) -> int:
    """How often the set can be fixed while all its lengths last."""
    need: dict[int, int] = {}
    for x in items:
        need[x] = need.get(x, 0) + 1
    return min(stock.n[x] // c for x, c in need.items())


def reduce_dominant(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Martello-Toth reduction: for each length, longest first, fix the set
    ``{length}`` or ``{length, partner}`` when it dominates every feasible set
    that holds a piece of this length.

    A set dominates another if the other's pieces can be laid out inside its
    pieces.  With ``room`` the space beside the piece and ``k`` the longest
    piece that fits there:

    * nothing fits: the piece alone;
    * ``k == room``: whatever else fits beside the piece fits inside ``k``;
    * the two shortest others exceed the room: at most one partner, ``k`` is best;
    * the three shortest others exceed the room: at most two partners, and
      ``{piece, k}`` dominates if ``k`` is no shorter than the best pair's sum.

    Returns the fixed (set, multiplicity) list and the remaining counts."""
    stock, fixed = Stock(counts), []
    for length in sorted(counts, reverse=True):
        while stock.n.get(length, 0):
            used, room = {length: 1}, capacity - length
            k = stock.largest_upto(room, used)
            if k == 0:
                chosen = [length]
            else:
                few = stock.smallest(3, used)
                if k == room or len(few) < 2 or few[0] + few[1] > room:
                    chosen = [length, k]
                elif (len(few) < 3 or sum(few) > room) and k >= _best_pair(stock, room, used):
                    chosen = [length, k]
                else:
                    break
            # Fixing pieces only lengthens the shortest rest and shrinks the best
            # pair, so the rule holds for as many sets as both lengths give.
            times = _bulk(stock, chosen)
            stock.take(chosen, times)
            fixed.append((chosen, times))
    return fixed, stock.n


def _best_pair(stock: Stock, room: int, used: dict[int, int]) -> int:
    """Largest sum of two remaining pieces that fits the room."""
    best = 0
    for x in reversed(stock.lengths):
        if x >= room or stock.n[x] <= used.get(x, 0):
            continue
        if 2 * x <= best:
            break
        both = dict(used)
        both[x] = both.get(x, 0) + 1
        y = stock.largest_upto(min(room - x, x), both)
        if y:
            best = max(best, x + y)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over (length, count): bins with one pattern are
    handled together, so the work follows the lengths and not the pieces."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> [(pattern, bins)]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                room, pattern, bins = capacity, (), -(-left // (capacity // length))
            # The fullest bin that takes a piece stays the fullest one until it takes no more.
            each = room // length
            full = min(bins, left // each)
            if full:
                put(room - each * length, pattern + (length,) * each, full)
                left -= full * each
                bins -= full
            if bins and left and left < each:
                put(room - left * length, pattern + (length,) * left, 1)
                left, bins = 0, bins - 1
            if bins and pattern:
                put(room, pattern, bins)
    return [(list(p), b) for v in open_bins.values() for p, b in v]


def slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first bin, bins, offset) of every place in every pattern."""
    fixed, rest = reduce_dominant(counts, capacity)
    out, rank, bin_at = [], dict.fromkeys(counts, 0), 0
    for pattern, bins in fixed + best_fit(rest, capacity):
        offset = 0
        for x in pattern:
            out.append((x, rank[x], bin_at, bins, offset))
            rank[x] += bins
            offset += x
        bin_at += bins
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (columns of ``pieces``, any more) with ``sequence_id`` and
    ``offset``.  The histogram that reaches the driver has at most ``capacity`` rows."""
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}
    table = spark.createDataFrame(slots(counts, capacity),
                                  "sl long, first long, first_bin long, bins long, offset long")
    # A rank looks up its slot by length and by the place of its slot in the sorted first ranks.
    starts = table.groupBy("sl").agg(F.sort_array(F.collect_list(
        F.struct("first", "first_bin", "bins", "offset"))).alias("at"))
    ranked = rows.dense_rank_of(cut, ["length"], [F.col("ka"), F.col("kb"), F.col("piece")], "rk")
    placed = ranked.join(F.broadcast(starts), F.col("length") == F.col("sl"))
    hit = F.filter("at", lambda s: (s["first"] <= F.col("rk")) & (F.col("rk") < s["first"] + s["bins"]))[0]
    return (placed.withColumn("_s", hit)
            .withColumn("sequence_id", F.col("_s.first_bin") + F.col("rk") - F.col("_s.first"))
            .withColumn("offset", F.col("_s.offset"))
            .drop("sl", "at", "_s", "rk"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to packed pieces (see ``pieces`` and ``pack``)."""
    cut = rows.stage(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity)
