"""Blocks of the shingle join: exact for every pair that links, and small in a corpus whose texts share phrases."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from qsumm.llm import jaccard, scan
from qsumm.session import ensure_checkpoint_dir


def classes_of(texts):
    buf, off = scan.texts_of(pa.array(texts))
    h, at = jaccard.shingle_sets(buf, off)
    return h, at, jaccard.class_numbers(h, at)


def test_linked_sets_meet_in_their_rarest_shared_shingles():
    rng = np.random.default_rng(11)
    for size in [*range(1, 40), 97, 400]:
        for _ in range(12):
            a = rng.choice(1 << 20, size, replace=False)
            drop = int(rng.integers(0, size // 4 + 1))
            b = np.concatenate([a[drop:], rng.choice(1 << 20, int(rng.integers(0, size // 3 + 1)), replace=False) + (1 << 20)])
            if not jaccard.linked(np.sort(a).astype(np.uint64), np.sort(b).astype(np.uint64)):
                continue
            level = rng.integers(0, 5, 1 << 21)  # any first order
            sets = [x[np.lexsort((x, level[x]))][:jaccard.prefix_length(len(x))] for x in (a, b)]
            n = np.array([len(a), len(b)])
            assert len(set(sets[0]) & set(sets[1])) >= jaccard.shared_least(n).max()
            # The second order is by any numbers; shingles of one set only are known not to be shared.
            fp = np.concatenate(sets)
            doc = np.repeat([0, 1], [len(x) for x in sets])
            extra = rng.random(1 << 21) < 0.3  # shared with sets that are not here
            both = set(sets[0]) & set(sets[1])
            keep = np.array([x in both or extra[x] for x in fp.tolist()])
            fp, doc = fp[keep], doc[keep]
            go = jaccard.rarest_shared(doc, fp, rng.integers(2, 9, 1 << 21)[fp], n)
            assert set(fp[go][doc[go] == 0]) & set(fp[go][doc[go] == 1])


def test_numbers_pass_through_planes():
    x = np.array([0, 1, 255, 256, (1 << 24) - 1, 7], np.int64)
    assert jaccard.from_planes(jaccard.planes(x, 3), 3).tolist() == x.tolist()
    assert jaccard.from_planes(jaccard.planes(x[:0], 5), 5).tolist() == []


def test_texts_with_common_phrases_make_no_block(spark):
    """A sixth of every text is phrases of a dozen other texts each; the sketch is as full as in a large corpus
    and tells nothing.  Only near copies may share a block."""
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(200)]
    texts = []
    for i in range(300):
        own = [f"w{i}x{j}" for j in range(130)]
        for k in rng.choice(200, 8, replace=False):
            own.insert(int(rng.integers(0, len(own))), phrases[k])
        texts.append(" ".join(own))
    near = [f"{t} end" for t in texts[:20]]
    _, at, c = classes_of(texts + near)
    frame = spark.createDataFrame([(int(k), int(n), t) for k, n, t in zip(c, np.diff(at), texts + near)],
                                  "c long, n long, text string").repartition(5)
    level = spark.sparkContext.broadcast(np.zeros(jaccard.SKETCH_CELLS, np.uint8))
    blocks = jaccard.components(jaccard.chains(frame, level, 7))
    got = {tuple(sorted(r["nodes"])) for r in blocks.groupBy("root").agg(F.collect_list("node").alias("nodes")).collect()}
    assert got == {tuple(sorted((int(c[i]), int(c[300 + i])))) for i in range(20)}


def test_repeated_rows_and_empty_texts_keep_their_components(spark):
    text = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)]
    rows = [(1, text[0]), (1, text[0]), (2, text[0]), (None, text[0] + " end"), (3, text[1]), (4, None), (5, " "), (None, None), (6, "One two"), (7, "one  TWO")]
    got = jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert found == sorted([(1, 56, 1), (1, 56, 1), (2, 56, 1), (None, 57, 1), (3, 56, 3), (4, 0, 4), (5, 0, 5), (None, 0, None), (6, 1, 6), (7, 1, 6)], key=repr)


def test_marked_texts_hold_all_members_and_few_others(spark):
    rng = np.random.default_rng(8)
    c = rng.integers(-2**63, 2**63, 4000, dtype=np.int64).tolist()
    texts = spark.createDataFrame([(x, 5, "t") for x in c], "c long, n long, text string").repartition(3)
    bits = spark.sparkContext.broadcast(jaccard.marks(spark.createDataFrame([(x,) for x in c[:300]], "node long").repartition(4)))
    got = {r["c"] for r in jaccard.marked(texts, bits).collect()}
    assert set(c[:300]) <= got and len(got) < 320
    none = spark.sparkContext.broadcast(jaccard.marks(spark.createDataFrame([], "node long")))
    assert jaccard.marked(texts, none).count() == 0


def test_stage_of_the_pipeline_leaves_no_texts_behind(spark):
    """Tables of whole texts that the search staged are gone before the next stage runs."""
    near = " ".join(f"w{j}" for j in range(80))
    docs = spark.createDataFrame([(i, f"{near} end{i}", "en", "s", 300) for i in range(4)] + [(9, "other words", "en", "s", 11)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    path = ensure_checkpoint_dir(spark).removeprefix("file:")
    there = set(os.listdir(path))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 9]
    left = [x for x in set(os.listdir(path)) - there if "text" in pq.ParquetDataset(f"{path}/{x}").schema.names]
    assert left == []
