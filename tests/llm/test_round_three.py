"""Whitening, decontamination and collocations against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from qsumm.llm import collocations, contamination, jaccard, language, quality, queries, toxicity, warc, whitening
from tests.conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, x int, id int, ids int, n int"


def vectors(spark, lists):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0) for i, v in lists], VECTORS)


def test_whitening_query_equals_dense_eigenvectors(spark):
    got = queries.QUERIES["op11_jacobi_whitening"](spark, SF_SMALL).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.array(rows["embedding"].tolist(), dtype=np.float64)).astype(np.int64) + 100_000
    c = x - x.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    e, q = e[::-1], q[:, ::-1][:, :8]
    want = (c @ q) / np.sqrt(e[:8])
    have = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(have - want * np.sign((have * want).sum(axis=0))).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:8], e[:8] / e.sum(), rtol=1e-10)
    assert got["identity_error"].max() < 1e-9 and set(got["n"]) == {len(x)}
    exact = len(x) * x - x.sum(axis=0)
    assert got["deviation"].tolist()[::8] == (exact * exact).sum(axis=1).tolist()


def test_jacobi_davidson_on_close_and_repeated_values():
    rng = np.random.default_rng(3)
    for e in ([9.0] * 4 + [8.999999] * 3 + list(np.linspace(5, 0, 60)), [1.0] * 30, [4.0, 2.0, 1.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(e), len(e))))
        a = (q * np.array(e)) @ q.T
        got, v = whitening.jacobi_davidson(a, len(e), 8)
        k = min(8, len(e))
        assert np.allclose(got, sorted(e)[::-1][:k], atol=1e-11)
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12 and np.abs(a @ v - v * got).max() < 1e-11


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a @ a.T
    q, _ = np.linalg.qr(rng.standard_normal((12, 3)))
    rhs = rng.standard_normal((12, 2))
    rhs -= q @ (q.T @ rhs)
    shifts = np.array([1.5, -0.5])
    t = whitening.minres_block(lambda b: a @ b, shifts, q, rhs, 40, rtol=1e-12)
    p = np.eye(12) - q @ q.T
    for i, s in enumerate(shifts):
        assert np.abs(p @ (a - s * np.eye(12)) @ p @ t[:, i] - rhs[:, i]).max() < 1e-8
    assert np.abs(q.T @ t).max() < 1e-12


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, 2.0]), (2, [1.5, 2.0, 2.0]), (None, [0.5, -2.0, 1.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, []), (10, [1.0])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2}  # four vectors, three of them distinct
    assert {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2}
    for lists in (good[:1], bad[:5], []):
        assert whitening.whiten(vectors(spark, lists)).collect() == []
    wide = whitening.whiten(vectors(spark, good[:3] + [(4, [3e38, 1.0, 0.0])])).collect()
    assert {r["deviation"] for r in wide} == {None} and all(np.isfinite(r["whitened"]) for r in wide)
    assert whitening.deviations(np.array([[1 << 40, 5]]), 3, [7, 8]) == [None]
    assert whitening.deviations(np.array([[1 << 20, 5]]), 3, [7, 8]) == [(3 * (1 << 20) - 7) ** 2 + 49]


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def hits(docs, items, width=10):
    out = []
    for key, text in docs:
        words = ITEM_WORD.findall(fold(text))
        gone, found = set(), set()
        for item, passage in items:
            w = ITEM_WORD.findall(fold(passage))
            n = min(width, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p:p + n] == w[s:s + n]:
                        gone.update(range(p, p + n))
                        found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(gone), len(found), digest, bool(gone)))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEM_TEXTS = [(1, "the end"), (2, None), (3, "!!"), (None, "c"), (10, "THE-end"), (7, "é"), (8, "q " * 12), (8, "b c"),
              (9, "one two three four five six seven eight nine ten eleven twelve"), (9, ""), (1, "the end")]
DOC_TEXTS = [(1, "a b c d"), (2, None), (3, ""), (4, "x The END. the end"), (None, "the end"), (4, "x The END. the end"),
             (5, "É è é the"), (6, "q " * 30), (7, "one two three four five six seven eight nine ten eleven"),
             (8, "two, three; four five six seven eight NINE ten eleven twelve one"), (9, "end the"),
             (10, "one two three four five six seven eight nine " * 400 + "ten")]


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    """Also with many small blocks: a pass holds one of them."""
    docs = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in DOC_TEXTS], "doc_id long, text string, n int, ka string, block string")
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEM_TEXTS], "item_id long, text string, n int")
    got = contamination.decontaminate(docs, items, block_bytes=block_bytes).cache()
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=repr) == hits(DOC_TEXTS, ITEM_TEXTS)
    for r in got.collect():
        assert sum(x["end"] - x["start"] for x in r["runs"]) == r["n_hit"] and len(r["items"]) == r["n_items"]
    assert contamination.decontaminate(docs, items.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert contamination.decontaminate(docs.limit(0), items).count() == 0


def test_rarest_shingle_leads_the_candidates(spark):
    """Windows of common words are looked up by the one rare shingle they hold."""
    docs = spark.createDataFrame([(i, "the of and " * 50) for i in range(20)] + [(99, "the of and zebra of and the")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the of and zebra of and the"), (2, "of zebra the")], "item_id long, text string")
    got = contamination.decontaminate(docs, items).where("contaminated").collect()
    assert [(r["doc_id"], r["n_hit"], r["items"]) for r in got] == [(99, 7, ["1"])]


def test_tile_sums_dense_and_sparse_alike():
    rng = np.random.default_rng(1)
    for size in (100, collocations.DENSE + 10):
        tile, want = collocations.Tile(), Counter()
        for _ in range(12):
            inner = rng.integers(0, 5000, size).astype("<i4")
            n = rng.integers(1, 9, size)
            tile.add(inner, n)
            for k, v in zip(inner.tolist(), n.tolist()):
                want[k] += v
        inner, n = tile.counts(40)
        assert dict(zip(inner.tolist(), n.tolist())) == {k: v for k, v in want.items() if v >= 40}
        assert (np.diff(inner) > 0).all()


def test_codes_follow_the_tiles_in_every_quadrant():
    a = np.array([5, 1 << 33, 5, 3000, 1 << 33, 0])
    b = np.array([7, 9, 7, 1, 9, 1 << 35])
    seen = 0
    for qa, qb, at in collocations._quadrants(a, b):
        code, n = collocations._summed([(collocations._codes(a[at], b[at]), np.ones(len(a[at]), np.int64))])
        seen += n.sum()
        ta, tb, inner = code >> np.uint64(43), code >> np.uint64(22) & np.uint64((1 << 21) - 1), code & np.uint64((1 << 22) - 1)
        x = (qa << 32) + (ta.astype(np.int64) << 11) + (inner.astype(np.int64) >> 11)
        y = (qb << 32) + (tb.astype(np.int64) << 11) + (inner.astype(np.int64) & 2047)
        assert Counter(dict(zip(zip(x.tolist(), y.tolist()), n.tolist()))) == Counter(zip(a[at].tolist(), b[at].tolist()))
    assert seen == 6


def test_packed_integers_and_lookups():
    for v in ([], [0], [-1, 5, 127], [-1, 70_000], [1 << 40, -3]):
        assert collocations.expand(collocations.squeeze(np.array(v, np.int64))).tolist() == v
    big = 1 << 40
    keys = [collocations.squeeze(np.array(x)) for x in ([1, big, 2, 3], [7, 9])]
    names = collocations.PairNames([(keys[0], np.array([10, 11])), (keys[1], np.array([12]))])
    asked = collocations.squeeze(np.array([1, big, 7, 1, 2, 3, 9, 3]))
    assert names.find(asked).tolist() == [10, 11, 12, -1]
    words = collocations.WordNames([(collocations.WordNames.pack([b"a", "\u00e9".encode()]), np.array([3, 4]))])
    assert words.find(collocations.WordNames.pack(["\u00e9".encode(), b"b", b"a"])).tolist() == [4, -1, 3]


def phrase_counts(docs):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def collocations_by_hand(docs, least, top):
    f, n = phrase_counts(docs)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(len(v) > len(w) and m == lang and 100 * b >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (m, v), b in cand.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_equal_brute_force(spark, monkeypatch):
    """Small chunks: phrases across chunk borders are counted once."""
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(12)] + ["É", "d'or", "X-Y"]
    docs = []
    for i in range(60):
        words = rng.choice(vocab, size=int(rng.integers(0, 120)), p=np.array([6] * 3 + [1] * 12) / 30).tolist()
        text = " ".join(w + rng.choice(["", "", "", ",", ". ", "\n", "\t"]) for w in words)
        docs.append((["en", "de", None, "und"][i % 4], text + " New  York\tCity hall. new york" * (i % 3)))
    docs += [("en", None), ("en", ""), ("xx", " . , "), docs[5], docs[5]]
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "lang string, text string, id int, f int").repartition(3)
    want = collocations_by_hand(docs, 5, 40)
    assert len(want) > 60 and any(p[2].count(" ") == 3 for p in want)
    got = collocations.top_phrases(frame, least=5, top=40)
    assert sorted(tuple(r[c] for c in PHRASES) for r in got.collect()) == want
    assert collocations.top_phrases(frame.limit(0)).count() == 0


def test_chunk_borders_count_every_phrase_once(spark):
    """The real chunk length, crossed by one long text."""
    n = collocations.CHUNK + 50
    docs = [("en", "a b c " * (n // 3))]
    frame = spark.createDataFrame(docs, "lang string, text string")
    got = {r["phrase"]: (r["a"], r["l"], r["r"]) for r in collocations.top_phrases(frame).collect()}
    f, _ = phrase_counts(docs)
    assert got and all(a == f["en", tuple(p.split(" "))] for p, (a, _, _) in got.items())


def test_one_representative_of_near_copies_with_null_and_equal_ids(spark):
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{i}" for i in rng.integers(0, 10_000, 120)) for _ in range(2)]
    near = [text[0] + f" end{i}" for i in range(5)]
    docs = spark.createDataFrame(list(zip([None, None, 5, 7, 7], near)) + [(None, text[1]), (None, ""), (3, ""), (3, ""), (None, None)],
                                 "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.representatives(docs).collect()), key=repr)
    assert kept == sorted([(5, near[2]), (None, text[1]), (None, ""), (3, ""), (None, None)], key=repr)


def test_archives_with_one_member_per_record():
    import gzip
    import zlib
    parts = [b"one", b"", b"x" * 300_000, b"four"]
    data = b"".join(gzip.compress(p) for p in parts)
    assert warc.unzipped(data) == b"".join(parts) and warc.unzipped(data, step=7) == b"".join(parts)
    for cut in (len(data) - 1, len(gzip.compress(parts[0])) + 5):
        with pytest.raises((ValueError, zlib.error)):
            warc.unzipped(data[:cut])


# Everything in the package that brings rows to the driver, and what bounds it.
FETCHES = {
    "collocations.py": {"collect": ["64 slices of the bit table, 8 MB in all"], "first": ["largest partition number"]},
    "contamination.py": {"collect": ["shingles of one block of windows, bounded by its bytes", "windows of one block, bounded by its bytes"],
                         "first": ["bytes of all windows", "number of blocks"]},
    "graph_ann.py": {"first": ["commonest length", "rows per norm band", "last shard"]},
    "jaccard.py": {"collect": ["256 slices of the sketch, bounded by SKETCH_CELLS"], "take": ["is a link left", "is a block big"]},
    "language.py": {"collect": ["fitting sample, bounded by its distinct rows"]},
    "mixing.py": {"first": ["largest error of a Newton step"]},
    "packing.py": {"collect": ["length histogram, at most CAPACITY rows"]},
    "quality.py": {"collect": ["one reference per language"]},
    "run_index.py": {"first": ["totals of owners with several texts"]},
    "toxicity.py": {"collect": ["fitting sample, bounded by its distinct rows"]},
    "whitening.py": {"collect": ["one row per entry of a block of directions", "one row per dimension"], "first": ["commonest length"]},
}


def test_every_fetch_to_the_driver_is_named_with_its_bound():
    from pathlib import Path
    found = {}
    for path in Path(collocations.__file__).parent.glob("*.py"):
        source = path.read_text()
        assert not re.search(r"toPandas\(|toLocalIterator\(|localCheckpoint|\.(tail|head)\(\d*\)|\.rdd\b", source), path.name
        for way in ("collect", "first", "take"):
            n = len(re.findall(rf"\.{way}\(1?\)", source))
            if n:
                found.setdefault(path.name, {})[way] = n
    assert found == {f: {w: len(b) for w, b in ways.items()} for f, ways in FETCHES.items()}


def test_fetched_sums_do_not_grow_with_repeated_rows(spark):
    """A thousand repeats of one vector bring the same number of rows to the driver."""
    few = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(12)]
    for lists in (few, few + few[:1] * 1000):
        x, d = whitening.integers(vectors(spark, lists), "vec_id", "embedding")
        n, total = whitening.sums(x, d)
        assert n == len(lists) and len(total) == 3
        assert len(whitening._summed(x, d, 6, lambda m: np.ones(6))) == 6


WORDS = {"en": "the and with that house river", "fr": "les dans une maison que rive"}


def tagged(spark, repeats=0, results=()):
    """Documents of two languages, a third of them toxic; the first one ``repeats`` times more."""
    rows = [(i, " ".join(WORDS[lang].split()[(i * k) % 6] for k in range(1, 40)) + (". vile scum" if i % 3 == 0 else "."), lang)
            for i, lang in enumerate(["en", "fr"] * 40)]
    d = spark.createDataFrame(rows + rows[:1] * repeats, "doc_id long, text string, lang string")
    for name in results:
        d = d.withColumn(name, d["doc_id"])
    return d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, toxic int")


def test_results_replace_columns_of_their_names(spark):
    d, labels = tagged(spark, results=("Lang_Pred", "lang_score", "toxicity", "quality", "a.b c"))
    got = language.identify(d, language.fit(d))
    assert got.columns == ["doc_id", "text", "lang", "toxicity", "quality", "a.b c", "lang_pred", "lang_score"]
    assert got.where("lang = lang_pred and `a.b c` = doc_id and toxicity = doc_id").count() == 80
    got = toxicity.score(d, toxicity.fit(d, labels))
    assert got.columns == [*(c for c in d.columns if c != "toxicity"), "toxicity"]
    assert got.where("(toxicity >= 0.5) = (doc_id % 3 = 0) and quality = doc_id").count() == 80
    got = quality.judge(d)
    assert got.columns == [*(c for c in d.columns if c != "quality"), "quality"]
    assert got.where("quality.n_words >= 39 and toxicity = doc_id").count() == 80
    kept = quality.kept_documents(d)  # no results here: the own column stays
    assert kept.columns == d.columns
    assert kept.where("quality = doc_id").count() == got.where("quality.kept").count()


def test_fitting_samples_hold_one_of_equal_rows(spark, monkeypatch):
    """A thousand repeats of one row bring nothing more to the driver and teach nothing more."""
    fetched = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda bags, **how: fetched.append(len(bags)) or train(bags, **how))
    models = []
    for repeats in (0, 1000):
        d, labels = tagged(spark, repeats)
        models.append((language.fit(d, per_language=20), toxicity.fit(d, labels, per_class=30)))
    assert (models[0][0].w == models[1][0].w).all()
    assert (models[0][1].weights == models[1][1].weights).all() and fetched == [57, 57]
