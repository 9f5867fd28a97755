"""Extractive selection (T1-T5): lead-k, seeded random-k, best-ROUGE-k, top-k by
model probability, seeded shuffle keys.  All in-row over a sentence array, so
no shuffle and no per-example group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qsumm.functions.text import rouge_tokens
from qsumm.operators.rouge import keep_shared, lcs_each_udf

# Fixed value: the seed used for sampling and both shuffles.
SEED = 13


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def seeded_hash(*parts) -> Column:
    """Portable seeded hash key: md5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                   for p in parts]))


def lead_k(sents, k: int = 3) -> Column:
    """First k sentences joined by one space (all when fewer)."""
    return F.array_join(F.slice(_c(sents), 1, k), " ")


def random_k(sents, key, k: int = 3, seed: int = SEED) -> Column:
    """K sentences without replacement, in draw order; all, in order, when fewer than k.

    The draw is the k smallest ``md5(seed|key|position)`` values.
    """
    s, key = _c(sents), _c(key)
    items = F.transform(s, lambda x, i: F.struct(seeded_hash(seed, key, i + 1).alias("h"),
                                                 (i + 1).alias("pos"), x.alias("sent")))
    drawn = F.transform(F.slice(F.array_sort(items), 1, k), lambda z: z["sent"])
    return F.when(F.size(s) < k, F.array_join(s, " ")).otherwise(F.array_join(drawn, " "))


def sentence_scores(sents, question) -> Column:
    """ROUGE-L f with alpha 1 of every sentence against the question: LCS over the
    sentence's token count (0 for a sentence without tokens)."""
    st = F.transform(_c(sents), rouge_tokens)
    qt = rouge_tokens(_c(question))
    # only tokens shared with the question can be in the LCS: ship those to the kernel
    lcs = lcs_each_udf(F.transform(st, lambda t: keep_shared(t, qt)), qt)
    return F.transform(F.arrays_zip(st.alias("t"), lcs.alias("l")), lambda z: F.when(
        F.size(z["t"]) > 0, z["l"] / F.size(z["t"])).otherwise(F.lit(0.0)))


def best_k(sents, scores, k: int = 3) -> Column:
    """The k best-scoring sentences (ties: later position wins), emitted in
    ascending score order (best last), ties by position."""
    s, sc = _c(sents), _c(scores)
    ranked = F.array_sort(F.transform(F.arrays_zip(s.alias("s"), sc.alias("v")), lambda z, i: F.struct(
        (-z["v"]).alias("nv"), (-(i + 1)).alias("np"), z["s"].alias("sent"))))
    top = F.transform(F.slice(ranked, 1, k), lambda z: F.struct(
        (-z["nv"]).alias("v"), (-z["np"]).alias("p"), z["sent"].alias("sent")))
    return F.array_join(F.transform(F.array_sort(top), lambda z: z["sent"]), " ")


def best_rouge_k(df: DataFrame, sents: str, question: str, k: int = 3, out: str = "gen") -> DataFrame:
    return df.withColumn("__scores", sentence_scores(sents, question)) \
             .withColumn(out, best_k(sents, "__scores", k)).drop("__scores")


def top_k_positions(probs, n_sents, k: int = 3, max_sentences: int | None = None) -> Column:
    """T4: positions (0-based) of the k highest probabilities among the first
    ``max_sentences`` (descending, lower index first on ties), then positions past
    the end of the document dropped."""
    p = _c(probs)
    if max_sentences is not None:
        p = F.slice(p, 1, max_sentences)
    ranked = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("nv"), i.alias("pos"))))
    top = F.transform(F.slice(ranked, 1, k), lambda z: z["pos"])
    return F.filter(top, lambda i: i < _c(n_sents))


def shuffle_key(key, seed: int = SEED, epoch: int | None = None) -> Column:
    """Reproducible random order key."""
    return seeded_hash(seed, key) if epoch is None else seeded_hash(epoch, seed, key)


def baselines(examples: DataFrame, key: str, sents: str, question: str, k: int = 3,
              seed: int = SEED, keep=None) -> DataFrame:
    """Long table ``(keep..., system, gen)`` for lead, random and best_rouge.

    Only ``keep`` columns (default: all but the article text and its sentence
    array) are carried through the three-way explode."""
    keep = [c for c in (keep or examples.columns) if keep or c not in ("article", sents)]
    gen = best_rouge_k(examples, sents, question, k, out="__best")
    wide = gen.withColumn("__lead", lead_k(sents, k)).withColumn("__rand", random_k(sents, key, k, seed))
    stacked = F.array(
        F.struct(F.lit("lead").alias("system"), F.col("__lead").alias("gen")),
        F.struct(F.lit("random").alias("system"), F.col("__rand").alias("gen")),
        F.struct(F.lit("best_rouge").alias("system"), F.col("__best").alias("gen")))
    return wide.select(*keep, F.explode(stacked).alias("__sys")).select(
        *keep, F.col("__sys.system").alias("system"), F.col("__sys.gen").alias("gen"))
