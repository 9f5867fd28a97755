"""Clipped n-gram counts against a direct count, and on long texts."""

import time

from pyspark.sql import functions as F

from qsumm.operators import bleu as bl


def _direct(h, r, n):
    grams = lambda t: [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]
    a, b = grams(h), grams(r)
    return sum(min(a.count(g), b.count(g)) for g in set(a))


def test_counts_equal_a_direct_count(spark):
    rows = [("abcabcab", "cabcab"), ("", "abc"), ("ab", ""), ("aé😀aé😀", "é😀a"), (None, "ab"), ("ab", None), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "h string, r string")
    got = bl.with_bleu_counts(df, bl.characters("h"), bl.characters("r"), unit="char").collect()
    for r in got:
        nums = [r[f"bleu_{n}_num"] for n in range(1, 5)]
        assert nums == ([None] * 4 if None in (r["h"], r["r"]) else [_direct(r["h"], r["r"], n) for n in range(1, 5)])


def test_long_texts_take_linear_time(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(60_000))
    df = spark.createDataFrame([(text, text[::-1])], "h string, r string")
    began = time.time()
    c = bl.with_bleu_counts(df, bl.characters("h"), bl.characters("r"), unit="char")
    assert c.select(F.col("bleu_1_num")).first()[0] == len(text)
    assert c.agg(F.sum("bleu_4_num")).first()[0] > 0
    assert time.time() - began < 60


def test_overlap_of_long_texts_is_sorted_once(spark):
    from qsumm.operators import rouge as rg

    words = [f"w{i * i % 97}" for i in range(60_000)]
    rows = [(words, words[::-2]), (words[:700], words[300:900] + ["x", "x"]), (["a"] * 600, ["a", "b"]), ([], words[:600]),
            (None, words[:600]), (words[:600], None), (["a", "b", "a"], ["a", "a", "a"])]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "i int, h array<string>, r array<string>")
    began = time.time()
    got = {r["i"]: r["n"] for r in df.select("i", rg.clipped_overlap("h", "r").alias("n")).collect()}
    assert time.time() - began < 40
    assert got == {i: None if h is None or r is None else _direct_unigrams(h, r) for i, (h, r) in enumerate(rows)}


def _direct_unigrams(h, r):
    from collections import Counter
    return (Counter(h) & Counter(r)).total()
