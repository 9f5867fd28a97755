"""Length-bucketed batches.

Examples are put in a seeded random order with consecutive ranks (no
single-partition window), cut into blocks of ``batch_size * cache`` ranks,
sorted by encoder length inside a block and cut into batches.  Windows are
partitioned by block or by batch, both bounded by the parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qsumm.operators.collection import dense_ids
from qsumm.operators.select import SEED, seeded_hash, shuffle_key
from qsumm.operators.vocab import PAD_ID, mask, pad_to


def make_batches(enc: DataFrame, key: str, batch_size: int = 16, cache: int = 100, seed: int = SEED,
                 max_dec_steps: int = 100) -> DataFrame:
    block_rows = batch_size * cache
    ranked = dense_ids(enc.withColumn("__h", shuffle_key(F.col(key), seed)), ["__h", key], "__rank")
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / block_rows).cast("long"))
    in_block = Window.partitionBy("block").orderBy("enc_len", key)
    b = (ranked.withColumn("__rn", F.row_number().over(in_block) - 1)
         .withColumn("batch_in_block", F.floor(F.col("__rn") / batch_size).cast("long"))
         .withColumn("slot", (F.col("__rn") % batch_size).cast("int"))
         .withColumn("batch_id", F.col("block") * cache + F.col("batch_in_block"))
         .withColumn("batch_order", seeded_hash(seed, F.col("block"), F.col("batch_in_block"))))
    per_batch = Window.partitionBy("batch_id")
    b = (b.withColumn("max_enc_len", F.max("enc_len").over(per_batch))
          .withColumn("max_art_oovs", F.max(F.size("article_oovs")).over(per_batch))
          .withColumn("enc_batch", pad_to("enc_input", F.col("max_enc_len"), PAD_ID))
          .withColumn("enc_batch_extend_vocab", pad_to("enc_input_extend_vocab", F.col("max_enc_len"), PAD_ID))
          .withColumn("enc_padding_mask", mask("enc_len", F.col("max_enc_len")))
          .withColumn("dec_batch", pad_to("dec_input", F.lit(max_dec_steps), PAD_ID))
          .withColumn("target_batch", pad_to("target", F.lit(max_dec_steps), PAD_ID))
          .withColumn("dec_padding_mask", mask("dec_len", F.lit(max_dec_steps))))
    return b.drop("__h", "__rank", "__rn")


def repeat_example(df: DataFrame, n: int = 16) -> DataFrame:
    """One example repeated ``n`` times (decode mode)."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def batch_maxima(batches: DataFrame) -> DataFrame:
    """Per batch, longest encoder sequence and most article OOVs."""
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("enc_len").alias("max_enc_len"),
                                           F.max(F.size("article_oovs")).alias("max_art_oovs"))


def _fit(arr, n: int, pad, truncate: str):
    """Cut or pad an array column to exactly ``n`` items."""
    c = F.col(arr) if isinstance(arr, str) else arr
    cut = F.slice(c, 1, n) if truncate == "tail" else F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)
    return F.concat(cut, F.array_repeat(pad, F.greatest(F.lit(0), F.lit(n) - F.size(cut)).cast("int")))


def pad_classifier_inputs(df: DataFrame, q_ids: str, sent_ids: str, labels: str | None = None,
                          max_tok_q: int = 50, max_sentences: int = 200, max_tok_sent: int = 50,
                          truncate: str = "tail") -> DataFrame:
    """Question ids to ``max_tok_q``; article ``max_sentences`` x ``max_tok_sent``
    (missing sentences are all-zero rows); labels to ``max_sentences``; pad 0.

    ``truncate='tail'`` keeps the first items everywhere (labels stay aligned
    with sentences); ``'head'`` keeps the last items of token lists and labels
    as a sequence padder that truncates in front would."""
    zero = F.lit(0)
    sents = F.col(sent_ids)
    docs = F.slice(sents, 1, max_sentences)
    docs = F.concat(docs, F.array_repeat(F.array().cast("array<int>"),
                                         F.greatest(F.lit(0), F.lit(max_sentences) - F.size(docs)).cast("int")))
    out = (df.withColumn("q_padded", _fit(q_ids, max_tok_q, zero, truncate))
             .withColumn("article_padded", F.transform(docs, lambda s: _fit(s, max_tok_sent, zero, truncate))))
    if labels:
        out = out.withColumn("labels_padded", _fit(labels, max_sentences, zero, truncate))
    return out
