"""Operators of the llm subpackage on small hand-made tables: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns, and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from qsumm.llm import (cover, graph_ann, jaccard, language, mixing, packing, quality, run_index, scan, toxicity,
                       warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, places string, ka string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(seed=5, n=40):
    """Random texts with exact copies, near copies, shared passages, null, empty and tiny ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(150))
    texts = []
    for i in range(n):
        body = " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 260)))
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body = body[:at] + " " + passage + " " + body[at:]
        texts.append(body + ("." if i % 3 else "\n" + body[:40]))
    near = texts[1].split(" ")
    near[len(near) // 2] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[5] * 2, "  \n", "", None, "two words", "ABC " * 60,
              " ".join(rng.choice(vocab) for _ in range(30_000))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, "x", "y")
            for i, t in enumerate(make_texts())]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def removed(units, starts, width):
    gone = [False] * len(units)
    for s in starts:
        gone[s:s + width] = [True] * width
    return gone


def test_run_index_dedup_equals_brute_force(docs, empty):
    width = 60
    raw = [(k, t.encode()) for k, t in pairs(docs)]
    seen = Counter(b[i:i + width] for _, b in raw for i in range(len(b) - width + 1))
    want = Counter()
    for k, b in raw:
        gone = removed(b, [i for i in range(len(b) - width + 1) if seen[b[i:i + width]] > 1], width)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    for group_texts in (run_index.GROUP_TEXTS, 1):  # 1: every owner takes the path of hot owners
        got = run_index.dedup(docs, window=width, gram=20, group_texts=group_texts)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
                       .collect()) == want
    assert run_index.dedup(empty).count() == 0


def test_repeated_windows_of_a_run_index():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    for w in (3, 8, 20):
        seen = Counter(t[i:i + w] for t in texts for i in range(len(t) - w + 1))
        for t, got in zip(texts, run_index.repeated_windows(texts, w)):
            assert got.tolist() == [i for i in range(len(t) - w + 1) if seen[t[i:i + w]] > 1]


def test_run_transform_is_shorter_than_a_repetitive_text():
    index = run_index.RunIndex([b"abracadabra" * 5] * 20, 200)
    assert index.runs < len(index.flat) / 5


def test_cover_dedup_equals_brute_force(docs, empty):
    words = [(k, WORD.findall(t)) for k, t in pairs(docs)]
    n = cover.WINDOW
    seen = Counter(tuple(w[i:i + n]) for _, w in words for i in range(len(w) - n + 1))
    want = Counter()
    for k, w in words:
        gone = removed(w, [i for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1], n)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = cover.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert cover.dedup(empty).count() == 0


def test_difference_cover_is_checked():
    with pytest.raises(ValueError):
        cover.shift_table(21, (0, 1, 2))


def shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(items):
    up = list(range(len(items)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(items):
        for j, (_, b) in enumerate(items[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    out = Counter()
    for i, (k, s) in enumerate(items):
        ids = [items[j][0] for j in range(len(items)) if find(j) == find(i) and items[j][0] is not None]
        out[k, len(s), min(ids) if ids else None] += 1
    return out


def test_jaccard_join_equals_brute_force(docs, empty):
    want = brute_components([(k, shingles(t)) for k, t in pairs(docs)])
    for options in ({}, {"block_bytes": 1, "tile_bytes": 4000}):  # the second: every block in tiles
        got = jaccard.cluster(docs, **options).select("id", "n_shingles", "component_id")
        assert Counter(tuple(r) for r in got.collect()) == want
    assert jaccard.cluster(empty).count() == 0


def test_representatives_keep_one_of_each_component(docs):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 40 not in ids and 3 in ids


def test_rtree_bound_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 200, replace=False), rng.integers(0, 2**63, k, dtype=np.uint64)]))
            for k in (0, 5, 30, 60)] + [np.unique(rng.choice(base, 390, replace=False)) for _ in range(40)]
    p, sizes = jaccard.points(sets, 64), np.array([len(s) for s in sets])
    tree = jaccard.RTree(p, sizes)
    for i, s in enumerate(sets):
        near = set(tree.candidates(p[i], len(s)).tolist())
        assert {j for j in range(len(sets)) if jaccard.linked(s, sets[j])} <= near


def test_graph_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.5, 2, size=(600, 1))
    x[100:200] = x[7]  # a group of equal vectors
    rows = [(i, v.astype(np.float32).tolist(), "z") for i, v in enumerate(x)]
    rows += [(900, None, "z"), (901, [0.0] * 12, "z"), (902, [float("nan")] * 12, "z"), (903, [1.0, None] + [0.0] * 10, "z")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = graph_ann.nearest(v, v.where("vec_id % 20 = 0"), k=20, shard_rows=200).collect()
    f = x.astype(np.float32).astype(np.float64)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 600, 20))
    hits = 0
    for q, found in by.items():
        s = f @ f[q]
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["id"]]) < 1e-9 for r in found)
        hits += len(set(want) & {r["id"] for r in found})
    assert hits / (20 * len(by)) >= 0.9
    assert graph_ann.nearest(v.where("vec_id >= 900"), v, k=3).count() == 0
    few = graph_ann.nearest(v.where("vec_id < 3"), v.where("vec_id < 1"), k=20).collect()
    assert len(few) == 2


def test_graph_neighbours_beside_very_long_and_short_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[5] *= 1e6
    x[6] *= 1e25
    x[7] *= 1e-6
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in graph_ann.nearest(v, v.where("vec_id % 20 = 5"), k=20).collect():
        by.setdefault(r["query_id"], set()).add(r["id"])
    assert set(by) == set(range(5, 1500, 20))
    hits = 0
    for q, got in by.items():
        want = [i for i in np.lexsort((np.arange(1500), -(x @ x[q]))) if i != q][:20]
        hits += len(set(want) & got)
    assert hits / (20 * len(by)) >= 0.9


def test_packing_round_trip(docs, empty, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs, capacity=256).collect()
    want = Counter()
    for k, t in pairs(docs):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 256):
            a = np.array(ids[p:p + 256], "<u4")
            want[k, p // 256, p, len(a), zlib.crc32(a.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 2
    assert packing.pack_documents(empty).count() == 0


def test_reduction_and_best_fit_place_every_piece():
    rng = random.Random(4)
    for _ in range(50):
        cap = rng.choice([10, 30, 100])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 200)))
        fixed, rest = packing.reduce_dominant(counts, cap)
        placed = Counter()
        for pattern, bins in fixed + packing.best_fit(rest, cap):
            assert sum(pattern) <= cap and bins > 0
            for x in pattern:
                placed[x] += bins
        assert placed == counts
        places = packing.slots(counts, cap)
        assert sum(b for *_, b, _ in places) == sum(counts.values())


def test_exact_complements_are_fixed_by_the_reduction():
    fixed, rest = packing.reduce_dominant({6: 3, 4: 2, 10: 1, 3: 1}, 10)
    assert ([6, 4], 2) in fixed and ([10], 1) in fixed and ([6, 3], 1) in fixed and not rest


def test_mixing_meets_targets(spark, empty):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), "l", ["s1", "s2", "s3", "hot", None][min(i % 9, 4)], "x")
            for i in range(900)]
    rows += [(None, None, "l", "s1", "x"), (5000, "w w w", None, "tiny", "x"), rows[0]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    total, by = 0, {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        total += r["size"]
        s = by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        s[2] += r["size"]
        s[3] += r["copies"] * r["size"]
    assert all(v[1] == v[2] for v in by.values())
    assert abs(sum(v[0] for v in by.values()) - min(1.5 * total, 2 * total)) < 1e-6 * total
    for target, size, _, taken in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 3
    again = mixing.mix(d).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_documents(d)
    assert copies.columns == d.columns and copies.count() == sum(r["copies"] for r in got)


def base_of(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    again = removed(words, [i for i, w in enumerate(windows) if seen[w] > 1], 8)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(again))


def test_quality_base_metrics_and_verdict(docs, empty):
    got = quality.judge(docs).collect()
    for r in got:
        q = r["quality"]
        want = base_of(r["text"] or "")
        assert tuple(q[m] for m in quality.METRICS) == want
        assert q["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (q["base_failed"] and q["kept"])
    assert quality.judge(docs).columns == [*docs.columns, "quality"]
    assert quality.judge(empty).count() == 0


def test_divergence_bounds():
    ref = np.array([0.5, 0.5, 0.0])
    d = quality.js_distance(np.array([[5, 5, 0], [0, 0, 3], [0, 0, 0]]), ref)
    assert d[0] == 0 and abs(d[1] - 1) < 1e-12 and d[2] == 0


def test_quality_rejects_symbol_junk(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    clean = [" ".join(word() for _ in range(150)) + "." for _ in range(60)]
    junk = [" ".join(word() + "###" for _ in range(150)) for _ in range(4)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.judge(d).where("quality.kept").collect()}
    assert kept == set(range(60))


def prose(rng, vocab, n):
    """``n`` words, every third a frequent one, with stops."""
    return " ".join(rng.choice(vocab[:40] if rng.random() < 0.37 else vocab[40:])
                    + ("." if i % 12 == 11 else "") for i in range(n))


def made_words(rng, n):
    return ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_quality_rejects_gibberish_of_ordinary_letters(spark):
    rng = random.Random(4)
    vocab, other = made_words(rng, 3000), made_words(rng, 30_000)
    clean = [prose(rng, vocab, n) for n in [150] * 60 + [60] * 20 + [400] * 20 + [2000] * 5 + [15]]
    junk = [" ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(rng.choices(other, k=n)))
            for n in (200, 300, 600, 3000)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.judge(d).where("quality.kept").collect()}
    assert kept == set(range(105))  # the clean text of 15 words fails the base rules


def test_quality_words_are_not_judged_without_common_words(spark):
    rng = random.Random(6)
    vocab = made_words(rng, 3000)
    clean = [prose(rng, vocab, 300) for _ in range(60)]
    # Runs of letters that hardly ever repeat, as in a script without blanks.
    wide = [" ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.randint(4, 12))) for _ in range(300))
            for _ in range(40)]
    junk = [" ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(made_words(rng, 300))) for _ in range(3)]
    d = spark.createDataFrame([(i, t, "en" if i < 60 else "zh" if i < 100 else "en")
                               for i, t in enumerate(clean + wide + junk)], "doc_id long, text string, lang string")
    refs = quality.references(d)
    assert [(r["lang"], quality.judges_words(r)) for r in refs] == [("en", True), ("zh", False)]
    kept = {r["doc_id"] for r in quality.judge(d, refs).where("quality.kept").collect()}
    assert kept == set(range(100))


def test_quality_junk_under_a_rare_tag_gives_no_reference(spark):
    rng = random.Random(7)
    vocab = made_words(rng, 3000)
    clean = [prose(rng, vocab, 300) for _ in range(240)]
    junk = [" ".join(w + "###" for w in made_words(rng, 150)) for _ in range(14)]
    tags = ["en"] * 240 + ["xx"] + ["yy"] * 11 + [None, "en"]  # 11 of 254 are too few
    d = spark.createDataFrame([(i, t, tags[i]) for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    assert [r["lang"] for r in quality.references(d)] == ["en"]
    kept = {r["doc_id"] for r in quality.judge(d).where("quality.kept").collect()}
    assert kept == set(range(240))
    assert quality.references(d.where("lang = 'xx'")) == []
    more = d.unionByName(d.where("lang = 'en'"))  # the guard is the same in a corpus of any size
    assert [r["lang"] for r in quality.references(more)] == ["en"]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\n", "x" * 50_000, "p"), (2, None, "x" * 50_000, "p"), (3, "u", "", "p"), (4, "u", None, "p"),
            (5, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.0 é", "p"), (None, "n", "only", "p"), (9, "u", "z" * 30_000, "p"),
            (9, "u", "z" * 30_000, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = warc.write_archives(pages, segment=1000)
    got = Counter(tuple(r) for r in warc.read_archives(spark, path).collect())
    d = warc.digest32
    assert got == Counter({
        (1, 50_000, d(b"x" * 50_000), "revisit", 2): 1, (2, 50_000, d(b"x" * 50_000), "response", None): 1,
        (3, 0, d(b""), "revisit", 4): 1, (4, 0, d(b""), "response", None): 1,
        (5, 25, d("WARC/1.1\r\n\r\n\r\nWARC/1.0 é".encode()), "response", None): 1,
        (None, 4, d(b"only"), "response", None): 1, (9, 30_000, d(b"z" * 30_000), "response", None): 2})
    none = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, none).count() == 0


def test_broken_segments_are_found(spark):
    pages = spark.createDataFrame([(1, "u", "q" * 5000)], "page_id long, url string, html string")
    parts = warc.read_parts(spark, warc.write_archives(pages, segment=1000))
    with pytest.raises(Exception, match="not complete"):
        warc.payloads(warc.reassemble(parts.where("number <> 3"))).collect()


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        payload = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(payload)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdeXX0\r\n\r\n")


def test_language_on_held_out_rows(spark, empty):
    rng = random.Random(8)
    stems = {"en": "the ing wh th ed", "de": "sch ein ung ch ber", "fr": "eau que ent é oi", "es": "ción ado ll ñ ue"}
    rows = []
    for i in range(400):
        lang = list(stems)[i % 4]
        text = " ".join("".join(rng.choices(stems[lang].split(), k=rng.randint(1, 4))) for _ in range(30))
        rows.append((i, text, lang, "x"))
    rows += [(1000, None, "en", "x"), (1001, "12 ,.", "en", "x"), (1002, "the thing", None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = language.fold(d["doc_id"], 4) == 2
    out = {r["doc_id"]: r for r in language.identify(d.withColumn("held", held), language.fit(d.where(~held))).collect()}
    tested = [out[i] for i, *_ in rows[:400] if out[i]["held"]]
    assert len(tested) > 50 and sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.97
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == "und" and out[1002]["lang_pred"] == "en"
    assert all(0 <= r["lang_score"] <= 1 for r in out.values())
    assert language.fit(empty) is None and language.identify(d, None).where("lang_pred <> 'und'").count() == 0


def test_language_sample_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 100)
    rng = random.Random(9)
    stems = {f"x{i}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4)] for i in range(20)}
    rows = []
    for i, (lang, own) in enumerate(stems.items()):
        for _ in range(4 if i == 0 else 20 + 15 * i):
            rows.append((len(rows), " ".join("".join(rng.choices(own, k=2)) for _ in range(20)), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    assert model.languages == sorted(stems)
    out = language.identify(d, model).where("lang = 'x0'").collect()
    assert [r["lang_pred"] for r in out] == ["x0"] * 4
    monkeypatch.setattr(language, "SAMPLE_ROWS", 5)  # fewer than the languages
    assert language.fit(d).languages == sorted(stems)


def test_toxicity_finds_documents_and_sentences(spark, empty):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "ole", "iru", "ept", "ume")]
    rows, labels = [], []
    for i in range(500):
        s = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(6)]
        if i % 5 == 0:
            s[rng.randrange(6)] += " vile scum"
        rows.append((i, ". ".join(s) + ".", "x"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, "x"), (1001, "", "x")]
    labels += [(2, None), (None, 1), (7777, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab.where(language.fold(lab["doc_id"], 5) != 0))
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, model).collect()}
    assert all((out[i] >= 0.5) == (i % 5 == 0) for i in range(500))
    assert out[1000] == out[1001] == 0
    found = toxicity.locate(d, model).collect()
    assert len(found) == 100 and all("scum" in r["sentence"] for r in found)
    nothing = toxicity.fit(d, lab.limit(0))
    assert {r["toxicity"] for r in toxicity.score(d, nothing).collect()} == {0.0}


def test_words_of_a_flat_chunk():
    texts = ["a  b", "", "\x0bc d e", "x"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    s, e, first = scan.words(buf, off)
    got = [bytes(buf[a:b]).decode() for a, b in zip(s, e)]
    assert got == [w for t in texts for w in WORD.findall(t)]
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]


def test_components_reach_the_smallest_node_of_long_chains(spark):
    rng = np.random.default_rng(5)
    names = rng.choice(10**12, 400, replace=False) - 5 * 10**11
    pairs = [(int(a), int(b)) for a, b in zip(names[:199], names[1:200])]  # one shuffled chain
    ordered = np.sort(names[200:300])
    pairs += [(int(b), int(a)) for a, b in zip(ordered[:-1], ordered[1:])]  # a sorted one, reversed edges
    pairs += [(int(names[300]), int(x)) for x in names[301:390]] * 2 + [(int(names[395]), int(names[395]))]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {int(x): int(g.min()) for g in (names[:200], names[200:300], names[300:390]) for x in g}
    assert got == want
    none = spark.createDataFrame([], "a long, b long")
    assert jaccard.components(none).count() == 0


def test_chains_join_what_shares_a_shingle_at_near_sizes():
    fp = np.array([1, 1, 1, 1, 2, 3, 3], np.uint64)
    c = np.array([10, 11, 12, 11, 13, 14, 15], np.int64)
    n = np.array([20, 21, 400, 21, 20, 30, 30], np.int64)
    *_, a, b = jaccard.chained(fp, c, n)
    assert list(zip(a.tolist(), b.tolist())) == [(10, 11), (14, 15)]
