"""Approximate nearest neighbours on robust-pruned directed graphs.

Largest inner product becomes smallest distance by one more coordinate: with M
the largest norm of a shard, x is indexed as (x, sqrt(M^2 - |x|^2)).  Equal
vectors are one node (copies beyond the first add no edge); nodes are dealt by
norm to bands (a factor of 2^``BAND_BITS`` wide, 270 at most) and inside a band
by a hash to shards of at most about ``SHARD_ROWS`` nodes, so very long or short
rows never share a shard with the others.  Vectors of a shard are scaled by a
power of two; the search ranks by the inner product itself.

Building.  Nodes are inserted in rounds that double in size.  A greedy beam
search over the graph so far proposes neighbours for all nodes of a round at
once; robust pruning keeps the nearest and drops every candidate that a kept
one is nearer to by the factor ``ALPHA``, so edges stay diverse; reverse edges
are added and pruned the same way.

Searching.  Queries are cut into blocks; every block meets every shard in a
task of its own (shard and block are bounded), runs the beam search there, and
keeps its best ``k`` per query.  Shard results are merged per query, nodes are
expanded to their rows, and scores are computed in double precision on the
original vectors.

Defined results: null or zero vectors and those with null or non-finite
components (or another length than the commonest one) take no part; ties go to
the smaller id; repeated rows are candidates of their own unless they are the
query's own id; with fewer candidates than ``k`` all are returned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rows

SHARD_ROWS = 1 << 13
DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
BLOCK = 1024  # queries of a search task
SALT = 8
BAND_BITS = 8


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): ids with vectors of doubles that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = (F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    v = v.where(F.coalesce(good, F.lit(False)))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return v.where(F.size("v") == (common["d"] if common else 0))


def nodes_of(v: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (node, v) and the smallest ``k + 1`` ids of each (node,
    id): no query needs more copies.  A node's number is its smallest id."""
    v = v.withColumn("h", F.xxhash64("v"))
    first = W.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy("id")
    few = v.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r", "h")
    ranked = few.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    ranked = rows.stage(ranked.withColumn("node", F.min("id").over(W.partitionBy("v"))), "ann-nodes")
    return ranked.where("r = 1").select("node", "v"), ranked.select("node", "id")


def _near(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[i] to rows b[i, :]."""
    norm = np.einsum("ij,ij->i", x, x)
    dot = np.matmul(x[b], x[a][:, :, None])[:, :, 0]
    return np.maximum(norm[b] + norm[a][:, None] - 2 * dot, 0)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, inner: bool = False):
    """Beam search of all queries in step: (nodes, squared distances) of the
    ``beam`` nearest found, nearest first; -1 pads.  ``graph``: node -> neighbours (-1: none).
    With ``inner`` the distance is the negative inner product."""
    n = len(q)
    rows_ = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = -(q @ x[entry]) if inner else ((x[entry] - q) ** 2).sum(1)
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    seen[:, entry] = True
    norm = (x * x).sum(1)
    live = rows_
    while len(live):
        open_ = (ids[live] >= 0) & ~done[live]
        has = open_.any(1)
        live = live[has]
        if not len(live):
            break
        at = open_[has].argmax(1)  # the beam is sorted: the nearest node not expanded yet
        done[live, at] = True
        new = graph[ids[live, at]]
        fresh = new >= 0
        fresh &= ~seen[live[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        d = np.full(new.shape, np.inf, np.float32)
        hit = new[r, c]
        dot = np.einsum("ij,ij->i", x[hit], q[live[r]])
        d[r, c] = -dot if inner else norm[hit] - 2 * dot + (q[live[r]] ** 2).sum(1)
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, new, -1)], 1)
        all_f = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), axis=1, kind="stable"), 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(all_i, best, 1)
        done[live] = np.take_along_axis(all_f, best, 1)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbour lists (-1 padded) of ``nodes`` from candidate lists (-1: none)."""
    n, m = cand.shape
    cand = np.where(cand == nodes[:, None], -1, cand)
    # Repeated candidates count once.
    order = np.argsort(cand, axis=1, kind="stable")
    s = np.take_along_axis(cand, order, 1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
    d = np.where(s >= 0, _near(x, nodes, np.maximum(s, 0)), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
    out = np.full((n, degree), -1, np.int64)
    filled = np.zeros(n, np.int64)
    alive = np.isfinite(d)
    own = x[np.maximum(cand, 0)]
    norm = np.einsum("ikj,ikj->ik", own, own)
    for _ in range(degree):
        live = np.flatnonzero(alive.any(1))
        if not len(live):
            break
        at = alive[live].argmax(1)
        pick = cand[live, at]
        out[live, filled[live]] = pick
        filled[live] += 1
        alive[live, at] = False
        near = norm[live] + norm[live, at][:, None] - 2 * np.einsum("ij,ikj->ik", own[live, at], own[live])
        alive[live] &= alpha * alpha * near > d[live]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, entry) of the vectors; the entry is the node nearest the mean."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    at, step = 1, 1

    def insert(batch: np.ndarray) -> None:
        for lo in range(0, len(batch), 512):
            part = batch[lo:lo + 512]
            found, _ = beam_search(x, graph, entry, x[part], beam)
            graph[part] = robust_prune(x, part, np.concatenate([found, graph[part]], 1), degree, alpha)
            src = np.repeat(part, degree)
            dst = graph[part].ravel()
            ok = dst >= 0
            src, dst = src[ok], dst[ok]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            target, first, count = np.unique(dst, return_index=True, return_counts=True)
            width = int(count.max()) if len(count) else 0
            if not width:
                continue
            back = np.full((len(target), width), -1, np.int64)
            back[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            both = np.concatenate([graph[target], back], 1)
            full = (both >= 0).sum(1) > degree
            if full.any():
                graph[target[full]] = robust_prune(x, target[full], both[full], degree, alpha)
            if (~full).any():
                packed = both[~full]
                packed = np.take_along_axis(packed, np.argsort(packed < 0, axis=1, kind="stable"), 1)[:, :degree]
                graph[target[~full]] = packed

    while at < n:
        insert(order[at:at + step])
        at, step = at + step, min(step * 2, 2048)
    return graph, entry


INDEX = "shard int, node long, v array<double>, neighbours array<int>, pos int, entry int"


def band_of(vec: str):
    """Norm band of a vector (binary logarithm, no overflow of squares); norms from 1/16 to 16 share one."""
    most = F.array_max(F.transform(vec, F.abs))
    squares = F.aggregate(vec, F.lit(0.0), lambda s, e: s + (e / most) * (e / most))
    return F.floor((F.log2(most) + F.log2(squares) / 2 + BAND_BITS / 2) / BAND_BITS).cast("int")


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: shard, position, vector, neighbour positions and the
    shard's entry position."""
    nodes = nodes.withColumn("band", band_of("v"))
    bands = nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    sizes = bands.agg(F.sort_array(F.collect_list(F.struct("band", "n")))).first()[0]
    first, shards, total = [F.lit(-1), F.lit(0)], [F.lit(-1), F.lit(1)], 0
    if sizes:
        first, shards = [], []
        for band, n in sizes:
            own = -(-int(n) // shard_rows)
            first += [F.lit(band), F.lit(total)]
            shards += [F.lit(band), F.lit(own)]
            total += own

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        v = table.column("v").combine_chunks()
        flat = scaled(np.asarray(v.flatten(), np.float64).reshape(len(table), -1))
        graph, entry = build_graph(lifted(flat, float(np.sqrt((flat * flat).sum(1).max()))))
        n = len(table)
        near = pa.array([g[g >= 0].astype(np.int32) for g in graph], pa.list_(pa.int32()))
        return pa.table({"shard": table.column("shard"), "node": table.column("node"), "v": table.column("v"),
                         "neighbours": near, "pos": pa.array(np.arange(n), pa.int32()),
                         "entry": pa.array(np.full(n, entry), pa.int32())})

    shard = F.create_map(*first)[F.col("band")] + F.pmod(F.xxhash64("node"), F.create_map(*shards)[F.col("band")])
    dealt = nodes.withColumn("shard", shard.cast("int")).select("shard", "node", "v")
    return rows.stage(dealt.groupBy("shard").applyInArrow(build, INDEX), "ann-index")


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over the power of two of their largest component."""
    return np.ldexp(x, 1 - int(np.frexp(np.abs(x).max())[1]))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes all norms ``top``."""
    more = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))
    return np.concatenate([x, more[:, None]], 1).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query, node, score): the best ``k + 1`` nodes of each shard by inner
    product in double precision.  ``queries``: query, qv."""
    total = max(1, -(-queries.count() // BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(total)).cast("int"))
    # A shard meets the query blocks one by one: each pair is a bounded task.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    last = index.agg(F.max("shard")).first()[0] or 0
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(last)))))

    def find(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not len(nodes) or not len(asked):
            return empty
        nodes = nodes.sort_by("pos")
        flat = np.asarray(nodes.column("v").combine_chunks().flatten(), np.float64).reshape(len(nodes), -1)
        graph = np.full((len(nodes), DEGREE), -1, np.int64)
        near = nodes.column("neighbours").combine_chunks()
        size = np.asarray(near.value_lengths())
        graph[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = \
            np.asarray(near.flatten())
        x = scaled(flat).astype(np.float32)
        q = np.asarray(asked.column("qv").combine_chunks().flatten(), np.float64).reshape(len(asked), -1)
        ask = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        ids, out_q, out_n, out_s = np.asarray(nodes.column("node")), [], [], []
        query = np.asarray(asked.column("query"))
        for lo in range(0, len(ask), 256):
            found, _ = beam_search(x, graph, nodes.column("entry")[0].as_py(), ask[lo:lo + 256], beam, True)
            for i, row in enumerate(found):
                row = row[row >= 0]
                s = (flat[row] * q[lo + i]).sum(1)
                best = np.lexsort((ids[row], -s))[:k + 1]
                out_q.append(np.full(len(best), query[lo + i]))
                out_n.append(ids[row[best]])
                out_s.append(s[best])
        return pa.table({"query": pa.array(np.concatenate(out_q)), "node": pa.array(np.concatenate(out_n)),
                         "score": pa.array(np.concatenate(out_s))})

    return (left.groupBy("shard", "block").cogroup(right.select("shard", "block", "query", "qv").groupBy("shard", "block"))
            .applyInArrow(find, "query long, node long, score double"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found rows of ``vectors``
    for every row of ``queries``, never the query's own id."""
    v = usable(vectors, id_col, vec_col)
    nodes, copies = nodes_of(v, k)
    index = build_index(nodes, shard_rows)
    q = usable(queries, id_col, vec_col).select(F.col("id").alias("query"), F.col("v").alias("qv"))
    q = rows.stage(q.dropDuplicates(["query"]), "ann-queries")
    found = search(index, q, k, beam)
    # k + 1 nodes hold the k best others; a node's rows tie and go by id.
    best = W.partitionBy("query").orderBy(F.col("score").desc(), "node")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    every = found.join(copies, "node").where(F.col("id") != F.col("query"))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", "id", "score"))
