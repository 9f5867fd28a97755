"""Vocabulary and id encoding.

Counting is a plain ``groupBy(word)`` with map-side partial counts.  The
vocabulary is capped by a parameter (the feature), so the id table has a
proven size bound and is broadcast into the token lookups; examples are
encoded with one ``posexplode`` + broadcast join + one regroup by example key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsumm.functions.text import SENT_END, SENT_START, ws_tokens
from qsumm.plans.joins import sized_broadcast

# Reserved words and their ids.
UNK, PAD, START, STOP = "[UNK]", "[PAD]", "[START]", "[STOP]"
RESERVED = [UNK, PAD, START, STOP]
UNK_ID, PAD_ID, START_ID, STOP_ID = 0, 1, 2, 3
COUNT_CAP = 200_000


def vocab_counts(texts: DataFrame, cols) -> DataFrame:
    """Whitespace-token counts over all ``cols`` (bag union), with empty
    tokens and sentence tags dropped.  ``(word, count)``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    toks = F.flatten(F.array(*[ws_tokens(c) for c in cols]))
    toks = F.filter(toks, lambda t: ~t.isin("", SENT_START, SENT_END))
    return (texts.select(F.explode(toks).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def top_words(counts: DataFrame, n: int = COUNT_CAP) -> DataFrame:
    """The ``n`` most frequent words (ties by word) with their frequency rank
    (0-based).  Ranked by a range-partitioned sort with per-partition offsets, so
    no single task ever merges partitions times ``n`` rows."""
    from qsumm.operators.collection import dense_ids
    ranked = dense_ids(counts.withColumn("__neg", -F.col("count")), ["__neg", "word"], "rank")
    return ranked.where(F.col("rank") < n).drop("__neg")


def vocab_lines(counts: DataFrame) -> DataFrame:
    """K3: ``word count`` text lines."""
    return counts.select(F.concat_ws(" ", "word", F.col("count").cast("string")).alias("value"))


def vocab_table(top: DataFrame, max_size: int = 50_000) -> DataFrame:
    """``(word, word_id)``: the reserved words take 0..3, then words by
    frequency rank until ``max_size`` ids (reserved included) are used.
    ``top`` carries the frequency ``rank`` from ``top_words``."""
    words = top if max_size == 0 else top.where(F.col("rank") < max_size - len(RESERVED))
    words = words.select("word", (F.col("rank") + len(RESERVED)).cast("int").alias("word_id"))
    spark = top.sparkSession
    reserved = spark.createDataFrame([(w_, i) for i, w_ in enumerate(RESERVED)], "word string, word_id int")
    return reserved.unionByName(words)


def parse_vocab_lines(lines: DataFrame, max_size: int = 50_000, col: str = "value",
                      order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Vocabulary from ``word count`` lines (``order`` = line number).

    Malformed lines (not exactly two fields) are skipped and returned as the
    second frame.  Reserved words or duplicate words raise (``raise_error``),
    as in the reference.  Words are kept in file order until ``max_size`` ids.
    """
    pieces = F.filter(F.split(F.col(col), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")
    parsed = lines.withColumn("__p", pieces)
    bad = parsed.where(F.size("__p") != 2).drop("__p")
    good = parsed.where(F.size("__p") == 2).select(order, F.col("__p")[0].alias("word"))
    reserved = RESERVED + [SENT_START, SENT_END]
    # duplicate check as an aggregate (map-side partial counts), not a window:
    # a word repeated on many lines never gathers its lines in one task
    dups = good.groupBy("word").agg(F.count(F.lit(1)).alias("__dups"))
    checked = good.join(dups, "word").withColumn(
        "word", F.when(F.col("word").isin(*reserved), F.raise_error(F.concat(F.lit("reserved word in vocabulary: "), "word")))
        .when(F.col("__dups") > 1, F.raise_error(F.concat(F.lit("duplicated word in vocabulary: "), "word")))
        .otherwise(F.col("word")))
    from qsumm.operators.collection import dense_ids
    ranked = dense_ids(checked.select(order, "word"), [order], "__rank")
    if max_size != 0:
        ranked = ranked.where(F.col("__rank") < max_size - len(RESERVED))
    words = ranked.select("word", (F.col("__rank") + len(RESERVED)).cast("int").alias("word_id"))
    spark = lines.sparkSession
    res = spark.createDataFrame([(w_, i) for i, w_ in enumerate(RESERVED)], "word string, word_id int")
    return res.unionByName(words), bad


def encode_examples(ex: DataFrame, key: str, article_words: str, abstract_words: str, vocab: DataFrame,
                    max_enc_steps: int = 400, max_dec_steps: int = 100, skip_empty: bool = True) -> DataFrame:
    """E1-E3 + J7/J8 + W6 + T8 for every example (F8: examples with an empty
    article are skipped when ``skip_empty``).

    Output adds ``enc_len, enc_input, enc_input_extend_vocab, article_oovs,
    dec_input, target, dec_len``; ``vocab_size`` = rows of ``vocab``.
    """
    if skip_empty:
        ex = ex.where(F.size(F.col(article_words)) > 0)
    vsize = vocab.count()
    v = sized_broadcast(vocab.select("word", "word_id"))
    art = F.slice(F.col(article_words), 1, max_enc_steps)
    toks = ex.select(key, F.posexplode(F.concat(
        F.transform(art, lambda w: F.struct(F.lit(0).alias("side"), w.alias("word"))),
        F.transform(F.col(abstract_words), lambda w: F.struct(F.lit(1).alias("side"), w.alias("word"))))
    ).alias("pos", "t")).select(key, "pos", "t.side", "t.word")
    looked = toks.join(v, "word", "left")
    grouped = looked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "side", "word", "word_id"))).alias("__t"))
    a = F.filter("__t", lambda z: z["side"] == 0)
    s = F.filter("__t", lambda z: z["side"] == 1)
    g = grouped.withColumn("__a", a).withColumn("__s", s)
    g = g.withColumn("article_oovs", F.array_distinct(F.transform(F.filter("__a", lambda z: z["word_id"].isNull()),
                                                                  lambda z: z["word"])))
    oov_id = lambda z: (F.lit(vsize) + F.array_position("article_oovs", z["word"]) - 1).cast("int")
    g = (g.withColumn("enc_input", F.transform("__a", lambda z: F.coalesce(z["word_id"], F.lit(UNK_ID))))
          .withColumn("enc_input_extend_vocab", F.transform("__a", lambda z: F.coalesce(z["word_id"], oov_id(z))))
          .withColumn("__abs", F.transform("__s", lambda z: F.coalesce(z["word_id"], F.lit(UNK_ID))))
          .withColumn("__abs_ext", F.transform("__s", lambda z: F.coalesce(
              z["word_id"], F.when(F.array_contains("article_oovs", z["word"]), oov_id(z)).otherwise(F.lit(UNK_ID))))))
    g = dec_inp_targ(g, "__abs", "__abs_ext", max_dec_steps)
    g = g.withColumn("enc_len", F.size("enc_input")).drop("__t", "__a", "__s", "__abs", "__abs_ext")
    empty = F.array().cast("array<int>")
    out = ex.join(g, key, "left")
    for c in ("enc_input", "enc_input_extend_vocab", "dec_input", "target"):
        out = out.withColumn(c, F.coalesce(c, empty))
    return (out.withColumn("article_oovs", F.coalesce("article_oovs", F.array().cast("array<string>")))
               .withColumn("enc_len", F.coalesce("enc_len", F.lit(0)))
               .withColumn("dec_len", F.coalesce("dec_len", F.lit(1)))
               .withColumn("dec_input", F.when(F.size("dec_input") == 0, F.array(F.lit(START_ID))).otherwise(F.col("dec_input")))
               .withColumn("target", F.when(F.size("target") == 0, F.array(F.lit(STOP_ID))).otherwise(F.col("target"))))


def dec_inp_targ(df: DataFrame, ids: str, ids_ext: str, max_len: int) -> DataFrame:
    """Decoder input ``[START]+ids`` and target ``ids+[STOP]``; when too long
    both are cut to ``max_len`` and the target has no ``[STOP]``."""
    inp = F.concat(F.array(F.lit(START_ID)), F.col(ids))
    long_ = F.size(inp) > max_len
    return (df.withColumn("dec_input", F.when(long_, F.slice(inp, 1, max_len)).otherwise(inp))
              .withColumn("target", F.when(long_, F.slice(F.col(ids_ext), 1, max_len))
                          .otherwise(F.concat(F.col(ids_ext), F.array(F.lit(STOP_ID)))))
              .withColumn("dec_len", F.size("dec_input")))


def pad_to(ids, n, pad: int = PAD_ID) -> Column:
    """E4."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(c)).cast("int")))


def mask(length, n) -> Column:
    """E5: ``length`` ones then zeros up to ``n``."""
    l = F.col(length) if isinstance(length, str) else length
    return F.concat(F.array_repeat(F.lit(1.0), l.cast("int")),
                    F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - l).cast("int")))


def decode_ids(df: DataFrame, key: str, ids: str, oovs: str, vocab: DataFrame, out: str = "words") -> DataFrame:
    """Ids back to words; ids past the vocabulary read the article OOV list,
    an id in neither raises.  ``posexplode`` + broadcast join on ``word_id`` +
    ordered regroup by example key."""
    vsize = vocab.count()
    v = sized_broadcast(vocab.select(F.col("word_id").alias("__id"), F.col("word").alias("__w")))
    e = df.select(key, oovs, F.posexplode(ids).alias("__pos", "__id")).join(v, "__id", "left")
    from_oov = F.element_at(F.col(oovs), (F.col("__id") - F.lit(vsize) + 1).cast("int"))
    e = e.withColumn("__w", F.coalesce("__w", F.when(F.col("__id") >= vsize, from_oov), F.raise_error(
        F.concat(F.lit("id not in vocabulary or article OOVs: "), F.col("__id").cast("string")))))
    g = e.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__pos", "__w"))).alias("__t"))
    g = g.select(key, F.transform("__t", lambda z: z["__w"]).alias(out))
    return df.join(g, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def show_oovs(words, known, oovs=None) -> Column:
    """``__w__`` for unknown words; with an article OOV list, unknown words not
    in it become ``!!__w__!!``.  ``known`` is a parallel boolean array."""
    w = F.col(words) if isinstance(words, str) else words
    k = F.col(known) if isinstance(known, str) else known
    def mark(z):
        plain = F.concat(F.lit("__"), z["w"], F.lit("__"))
        if oovs is None:
            return F.when(z["k"], z["w"]).otherwise(plain)
        return F.when(z["k"], z["w"]).when(F.array_contains(F.col(oovs), z["w"]), plain).otherwise(
            F.concat(F.lit("!!"), plain, F.lit("!!")))
    return F.array_join(F.transform(F.arrays_zip(w.alias("w"), k.alias("k")), mark), " ")
