"""Metric properties on real rows."""

from pyspark.sql import functions as F

from qsumm.functions.text import rouge_tokens, sentences
from qsumm.operators import rouge as rg
from qsumm.plans import catalog

SF = "/root/testdata/sf0.001"


def test_jvm_lcs_equals_arrow_lcs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(sentences("text")).alias("s")).limit(400)
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("text").alias("q")).limit(3)
    pairs = d.crossJoin(q)  # test-only brute force over a small fixture
    t = pairs.select(rouge_tokens("s").alias("a"), rouge_tokens("q").alias("b"))
    diff = t.where(rg.lcs_jvm("a", "b") != rg.lcs_udf("a", "b")).count()
    assert diff == 0


def test_rouge_bounds_and_identity(spark):
    preds = catalog.baseline_predictions(spark, SF)
    s = rg.with_rouge(preds, "gen", "summary")
    cols = [c for c in s.columns if c.startswith("rouge_") and c[-2:] in ("_p", "_r", "_f")]
    bad = s.where(" OR ".join(f"{c} < 0 OR {c} > 1" for c in cols)).count()
    assert bad == 0
    same = rg.with_rouge(preds.withColumn("gen", F.col("summary")), "gen", "summary")
    assert same.where("rouge_1_r < 1 OR rouge_l_r < 1").where("size(regexp_extract_all(lower(summary), '[a-z0-9]+', 0)) > 2").count() == 0


def test_label_count_equals_sentence_count(spark):
    from qsumm.plans.catalog_model import labelled
    lab = labelled(spark, SF)
    assert lab.where(F.size("labels") != F.size("sents")).count() == 0


def test_exploded_overlap_equals_in_row(spark):
    from qsumm.operators.bleu import characters
    b = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("item_id"),
                                                             F.substring("text", 1, 600).alias("other"))
    j = b.join(d, "item_id").select("item_id", characters("text").alias("h"), characters("other").alias("r"))
    a = j.withColumn("in_row", rg.clipped_overlap("h", "r"))
    e = rg.clipped_overlap_exploded(a, "item_id", "h", "r", "exploded")
    assert e.where("in_row != exploded").count() == 0
    assert e.where("in_row > 0").count() > 0


def test_distinct_count_exact_and_approx(spark):
    from qsumm.operators.stats import distinct_count
    from qsumm.functions.urls import host
    p = spark.read.parquet(f"{SF}/pages.parquet").select(host("url").alias("h"))
    exact = p.agg(distinct_count("h").alias("n")).first().n
    approx = p.agg(distinct_count("h", approx=True).alias("n")).first().n
    assert exact == p.select("h").distinct().where("h IS NOT NULL").count()
    assert abs(approx - exact) <= max(1, 0.05 * exact)


def test_epoch_shuffle_is_reproducible_and_changes_per_epoch(spark):
    from qsumm.operators.select import shuffle_key
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    order = lambda epoch: [r.k for r in df.orderBy(shuffle_key(F.col("k"), 13, epoch), "k").collect()]
    assert order(1) == order(1)
    assert order(1) != order(2)
    assert sorted(order(1)) == sorted(order(2))


def test_exact_p_value_equals_enumeration(spark):
    from itertools import product

    from qsumm.operators.stats import with_p_value
    rows = [(n, float(t), -1.0, tie) for n in (1, 3, 7) for t in (0, 2, n) for tie in (0, 6)]
    df = spark.createDataFrame(rows, "n long, t_stat double, z double, tie_term long")
    for r in with_p_value(df, "exact").collect():
        if r.tie_term:
            assert r.p_value is None
            continue
        sums = [sum(k + 1 for k, s in enumerate(signs) if s) for signs in product((0, 1), repeat=r.n)]
        assert abs(r.p_value - min(1.0, 2.0 * sum(s <= r.t_stat for s in sums) / len(sums))) < 1e-12
    assert all(abs(r.p_value - 0.3173105) < 1e-6 for r in with_p_value(df, "normal").collect())


def test_poisson_weights_have_no_cap():
    import math

    from qsumm.operators.stats import UNIFORM_BITS, poisson1_cdf
    cdf = poisson1_cdf()
    assert cdf[-1] > 1.0 - 2.0 ** -UNIFORM_BITS
    assert all(abs(c - math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) < 1e-12
               for k, c in enumerate(cdf))


def test_bootstrap_sums_equal_multiplied_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from qsumm.operators import stats as st
    b = 40
    rows = [(None if i % 7 == 0 else f"s{i % 3}", None if i == 11 else f"e{i}", None if i % 5 == 0 else i / 9.0, i % 4 / 3.0)
            for i in range(120)] + [("empty", "x", None, None)]
    df = spark.createDataFrame(rows, "system string, ex string, x double, b double").repartition(5)
    got = {r["system"]: r for r in st.bootstrap_ci(df, "system", "ex", ["x", "b"], b=b).collect()}
    small = {r["system"]: r for r in st.bootstrap_ci(df, "system", "ex", ["x", "b"], b=b, cells=1).collect()}
    rep = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn(
        "w", st.poisson_weight(st.uniform_from_md5(13, F.col("ex"), F.col("r"))))
    for m in ("x", "b"):
        want = rep.where(F.col(m).isNotNull()).groupBy("system", "r").agg(
            F.try_divide(F.sum(F.col(m) * F.col("w")), F.sum("w")).alias("v"))
        by = {}
        for r in want.collect():
            if r["v"] is not None:
                by.setdefault(r["system"], []).append(r["v"])
        assert set(got) == set(small) == {None, "s0", "s1", "s2", "empty"}
        for k, vs in by.items():
            for res in (got, small):
                assert np.allclose([res[k][f"{m}_cb"], res[k][f"{m}_ce"]], np.quantile(vs, [0.025, 0.975]))
        assert got["empty"][m] is None and got["empty"][f"{m}_cb"] is None


def test_bootstrap_multiplies_no_rows(spark):
    from qsumm.operators import stats as st
    df = spark.createDataFrame([("a", "e1", 0.5)], "system string, ex string, x double")
    plan = st.bootstrap_ci(df, "system", "ex", ["x"], b=1000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_rolled_up_statistics_equal_numpy(spark):
    import numpy as np

    from qsumm.operators import stats as st
    rows = [(None if i % 6 == 0 else f"d{i % 2}", None if i % 5 == 0 else f"t{i % 3}", None if i % 8 == 0 else (i * i) % 23)
            for i in range(101)] + [("d0", "t0", 7)] * 40 + [("one", "t9", 3)]
    df = spark.createDataFrame(rows, "a string, b string, x long").repartition(4)
    got = {(r["level"], r["a"], r["b"]): r for r in st.rollup_describe(df, ["a", "b"], "x", "x").collect()}
    want = {}
    for a, b, x in rows:
        if x is not None:
            for k in ((2, a, b), (1, a, None), (0, None, None)):
                want.setdefault(k, []).append(x)
    assert set(got) == set(want)
    for k, xs in want.items():
        r = got[k]
        assert r["n"] == len(xs)
        assert np.allclose([r["x_mean"], r["x_median"], r["x_std"]], [np.mean(xs), np.median(xs), np.std(xs)], atol=1e-6)
    assert st.rollup_describe(df.where("a = 'none'"), ["a"], "x", "x").count() == 0
