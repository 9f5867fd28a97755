"""J13 containment join against brute force on a small hand-made fixture,
including passages shorter than three tokens that occur inside words."""

from qsumm.operators.matching import passage_matches


def test_containment_matches_brute_force(spark):
    docs = [
        (1, "The quick brown fox jumps over the lazy dog."),
        (2, "A lazy afternoon; the dog sleeps.\nThe fox waits."),
        (3, "Unrelated text about spreadsheets and numbers."),
        (4, "foxes jumped; brownish dogs"),
        (5, ""),
    ]
    passages = [
        (10, "quick brown fox jumps"),      # whole tokens
        (11, "he lazy dog."),               # starts mid-word
        (12, "fox"),                         # one token, also inside 'foxes'
        (13, "own fox"),                     # two tokens, first one mid-word
        (14, "sheets and"),                  # two tokens, mid-word start
        (15, "not present anywhere at all"),
        (16, "a"),                           # one character
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(passages, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in passage_matches(d, p).collect()}
    want = {(i, j) for i, pt in passages for j, dt in docs if pt in dt}
    assert got == want


def test_short_passage_after_many_long_ones_is_found(spark):
    from qsumm.operators.matching import passage_matches

    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    pas = spark.range(5000).selectExpr("id AS item_id", "concat('no such passage here ', id) AS text").unionAll(
        spark.createDataFrame([(9999, "beta"), (10000, "gamma delta epsilon")], "item_id long, text string"))
    assert {r["item_id"] for r in passage_matches(docs, pas).collect()} == {9999, 10000}


def test_passages_of_common_words_have_few_candidates(spark):
    """Every word is in every document: single words would make all pairs candidates."""
    import random

    from pyspark.sql import functions as F

    from qsumm.operators.matching import rarest_runs

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, k=300))) for i in range(200)] + [(200, None)]
    passages = [(i, " ".join(docs[i * 5][1].split()[20:20 + n])) for i, n in enumerate([6, 7, 8, 12, 30] * 8)]
    passages += [(100, " ".join(docs[0][1].split()[50:53])), (101, "w1 w2 w1 never w3 w4")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(passages, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in passage_matches(d, p).collect()}
    want = {(i, j) for i, pt in passages for j, dt in docs if dt and pt in dt}
    assert got == want and len(want) >= 41
    long_ones = p.where("item_id < 100 or item_id = 101").select(F.col("item_id").alias("__pk"), F.col("text").alias("__pt"))
    runs, anchors = rarest_runs(d.select(F.col("doc_id").alias("__dk"), F.col("text").alias("__dt")), long_ones, [4])
    assert anchors.where("__pk = 101").count() == 0  # a word that no document has
    assert runs.join(anchors, "__run").count() <= 10 * sum(i < 100 for i, _ in want)


def test_documents_are_hashed_once(spark, scratch):
    """Counting the runs and pairing them read the documents' runs, not the documents again."""
    from qsumm.operators.matching import rarest_runs

    texts = [(i, f"a{i % 7} b c d e{i % 3} f g h") for i in range(300)] + [(300, None), (301, "  lead b c d e0 ")]
    passages = [(1, "x1 b c d e2 f x"), (2, "3 b c d e0 f g "), (3, "a b c"), (4, "a b c d")]
    spark.createDataFrame(texts, "__dk long, __dt string").write.parquet(f"{scratch}/docs")
    p = spark.createDataFrame(passages, "__pk long, __pt string")
    runs, anchors = rarest_runs(spark.read.parquet(f"{scratch}/docs"), p, [4, 2, 1])
    assert not runs.inputFiles() and not anchors.inputFiles()
    pairs = runs.join(anchors, "__run").groupBy("__pk").count().collect()
    assert {r["__pk"]: r["count"] for r in pairs} == {1: 100, 2: 100, 3: 301, 4: 301}
