"""Catalogue: vocabulary, id encoding and batching (A8, T6, W5, K3, J7-J9, W6,
E1-E5, E7, T7, T8, A18, P26) over whole driver tables.

The vocabulary is counted over every document and every benchmark passage;
encoded examples are the passage examples (article = document, abstract =
passage).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import batching as bt
from qsumm.operators import vocab as vb
from qsumm.plans import examples as exs
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import PAIRS_SQL, query
from qsumm.session import cut_lineage
from qsumm.sources.tables import table

MAX_SIZE = 50_000
MAX_ENC, MAX_DEC = 400, 100
BATCH, CACHE = 4, 2


def _clean_tokens_sql(x):
    return f"list_filter({sq.ws_tokens(x)}, lambda t: t NOT IN ('', '<s>', '</s>'))"


VOCAB_SQL = f"""
toks AS (
  SELECT unnest({_clean_tokens_sql('text')}) AS word FROM documents
  UNION ALL SELECT unnest({_clean_tokens_sql('text')}) FROM benchmark
),
counts AS (SELECT word, count(*) AS count FROM toks GROUP BY word),
top AS (SELECT * FROM counts ORDER BY count DESC, word LIMIT {vb.COUNT_CAP}),
ids AS (
  SELECT word, CAST(row_number() OVER (ORDER BY count DESC, word) + 3 AS INTEGER) AS word_id
  FROM (SELECT * FROM top ORDER BY count DESC, word LIMIT {MAX_SIZE - 4})
),
vocab AS (
  SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[START]', 2), ('[STOP]', 3)) v(word, word_id)
  UNION ALL SELECT word, word_id FROM ids
)"""


def vocabulary(spark, sf_dir):
    """(top words with counts and ranks, id table); materialized once per
    application and input folder, like the vocabulary file of the original."""
    def build_top():
        docs = table(spark, sf_dir, "documents").select("text")
        bench = table(spark, sf_dir, "benchmark").select("text")
        counts = vb.vocab_counts(docs.unionByName(bench), ["text"])
        return vb.top_words(counts, vb.COUNT_CAP)
    top = exs._memo(spark, "vocab_top", sf_dir, build_top)
    vocab = exs._memo(spark, "vocab_ids", sf_dir, lambda: vb.vocab_table(top, MAX_SIZE))
    return top, vocab


@query("vocab_top", f"""
WITH {VOCAB_SQL.strip()}
SELECT t.word, CAST(t.count AS BIGINT) AS count, t.word || ' ' || CAST(t.count AS VARCHAR) AS line,
       CAST(i.word_id AS BIGINT) AS word_id
FROM top t LEFT JOIN ids i USING (word)
""")
def q_vocab_top(spark, sf_dir):
    """A8/U5/F9 counts, T6 top-n, K3 line form, W5 ids."""
    top, vocab = vocabulary(spark, sf_dir)
    return (top.join(vocab, "word", "left")
            .select("word", F.col("count").cast("long").alias("count"),
                    F.concat_ws(" ", "word", F.col("count").cast("string")).alias("line"),
                    F.col("word_id").cast("long").alias("word_id")))


ENCODE_SQL = f"""
{VOCAB_SQL.strip()},
{PAIRS_SQL.strip()},
vsize AS (SELECT CAST(count(*) AS BIGINT) AS n FROM vocab),
ex AS (SELECT item_id, doc_id, article, summary, {sq.ws_tokens('article')}[1:{MAX_ENC}] AS aw,
              {sq.ws_tokens('summary')} AS sw FROM pairs),
atok AS (SELECT item_id, doc_id, unnest(range(1, len(aw) + 1)) AS pos, unnest(aw) AS word FROM ex),
alook AS (SELECT a.*, v.word_id FROM atok a LEFT JOIN vocab v USING (word)),
aoov AS (
  SELECT item_id, doc_id, word, CAST(row_number() OVER (PARTITION BY item_id, doc_id ORDER BY min(pos)) - 1 AS BIGINT) AS oov_idx
  FROM alook WHERE word_id IS NULL GROUP BY item_id, doc_id, word
),
aenc AS (
  SELECT l.item_id, l.doc_id,
         list(CAST(coalesce(l.word_id, 0) AS BIGINT) ORDER BY l.pos) AS enc_input,
         list(CAST(coalesce(l.word_id, (SELECT n FROM vsize) + o.oov_idx) AS BIGINT) ORDER BY l.pos) AS enc_ext
  FROM alook l LEFT JOIN aoov o ON o.item_id = l.item_id AND o.doc_id = l.doc_id AND o.word = l.word
  GROUP BY l.item_id, l.doc_id
),
oovs AS (SELECT item_id, doc_id, list(word ORDER BY oov_idx) AS oovs FROM aoov GROUP BY item_id, doc_id),
stok AS (SELECT item_id, doc_id, unnest(range(1, len(sw) + 1)) AS pos, unnest(sw) AS word FROM ex),
senc AS (
  SELECT s.item_id, s.doc_id,
         list(CAST(coalesce(v.word_id, 0) AS BIGINT) ORDER BY s.pos) AS abs_ids,
         list(CAST(coalesce(v.word_id, (SELECT n FROM vsize) + o.oov_idx, 0) AS BIGINT) ORDER BY s.pos) AS abs_ext
  FROM stok s LEFT JOIN vocab v USING (word)
       LEFT JOIN aoov o ON o.item_id = s.item_id AND o.doc_id = s.doc_id AND o.word = s.word
  GROUP BY s.item_id, s.doc_id
),
enc AS (
  SELECT e.item_id, e.doc_id, e.aw,
         coalesce(a.enc_input, []::BIGINT[]) AS enc_input, coalesce(a.enc_ext, []::BIGINT[]) AS enc_ext,
         coalesce(o.oovs, []::VARCHAR[]) AS oovs,
         coalesce(s.abs_ids, []::BIGINT[]) AS abs_ids, coalesce(s.abs_ext, []::BIGINT[]) AS abs_ext
  FROM ex e LEFT JOIN aenc a USING (item_id, doc_id) LEFT JOIN oovs o USING (item_id, doc_id)
       LEFT JOIN senc s USING (item_id, doc_id)
),
dec AS (
  SELECT *,
    CASE WHEN len(abs_ids) + 1 > {MAX_DEC} THEN ([2::BIGINT] || abs_ids)[1:{MAX_DEC}] ELSE [2::BIGINT] || abs_ids END AS dec_input,
    CASE WHEN len(abs_ids) + 1 > {MAX_DEC} THEN abs_ext[1:{MAX_DEC}] ELSE abs_ext || [3::BIGINT] END AS target
  FROM enc
)"""


def _ids_md5_sql(x):
    return f"md5(array_to_string({x}, ' '))"


def _ids_md5(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))


def encoded(spark, sf_dir):
    ex = exs.passage_examples(spark, sf_dir)
    ex = ex.withColumn("aw", tx.ws_tokens("article")).withColumn("sw", tx.ws_tokens("summary"))
    _, vocab = vocabulary(spark, sf_dir)
    return vb.encode_examples(ex, "ex_key", "aw", "sw", vocab, MAX_ENC, MAX_DEC), vocab


@query("encoded_examples", f"""
WITH {ENCODE_SQL.strip()}
SELECT item_id, doc_id, CAST(len(enc_input) AS BIGINT) AS enc_len, {_ids_md5_sql('enc_input')} AS enc_md5,
       {_ids_md5_sql('enc_ext')} AS enc_ext_md5, CAST(len(oovs) AS BIGINT) AS n_oovs,
       md5(array_to_string(oovs, ' ')) AS oovs_md5, CAST(len(dec_input) AS BIGINT) AS dec_len,
       {_ids_md5_sql('dec_input')} AS dec_md5, {_ids_md5_sql('target')} AS target_md5
FROM dec
""")
def q_encoded_examples(spark, sf_dir):
    """Article and abstract ids with article OOV ids."""
    enc, _ = encoded(spark, sf_dir)
    return enc.select("item_id", "doc_id", F.col("enc_len").cast("long").alias("enc_len"),
                      _ids_md5("enc_input").alias("enc_md5"), _ids_md5("enc_input_extend_vocab").alias("enc_ext_md5"),
                      F.size("article_oovs").cast("long").alias("n_oovs"),
                      F.md5(F.array_join("article_oovs", " ")).alias("oovs_md5"),
                      F.col("dec_len").cast("long").alias("dec_len"),
                      _ids_md5("dec_input").alias("dec_md5"), _ids_md5("target").alias("target_md5"))


@query("decoded_roundtrip", f"""
WITH {ENCODE_SQL.strip()}
SELECT item_id, doc_id,
       md5(array_to_string(list_transform(aw, lambda w: CASE WHEN list_contains(oovs, w) THEN '__' || w || '__' ELSE w END), ' '))
         AS shown_md5,
       true AS roundtrip
FROM dec
""")
def q_decoded_roundtrip(spark, sf_dir):
    """J9 ids back to words (must give the truncated article back) and P26 OOV marking."""
    enc, vocab = encoded(spark, sf_dir)
    j = vb.decode_ids(enc.withColumn("aw_cut", F.slice("aw", 1, MAX_ENC)), "ex_key", "enc_input_extend_vocab",
                      "article_oovs", vocab, "back")
    known = F.transform("aw_cut", lambda w: ~F.array_contains("article_oovs", w))
    return j.select("item_id", "doc_id", F.md5(vb.show_oovs("aw_cut", known)).alias("shown_md5"),
                    (F.col("back") == F.col("aw_cut")).alias("roundtrip"))


@query("batches", f"""
WITH {ENCODE_SQL.strip()},
r AS (
  SELECT *, concat_ws(':', item_id, doc_id) AS ex_key,
         row_number() OVER (ORDER BY md5(concat_ws('|', '13', concat_ws(':', item_id, doc_id))), concat_ws(':', item_id, doc_id)) - 1 AS rnk
  FROM dec
),
b AS (SELECT *, CAST(floor(rnk / {BATCH * CACHE}) AS BIGINT) AS block FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY len(enc_input), ex_key) - 1 AS rn FROM b),
t AS (SELECT *, block * {CACHE} + CAST(floor(rn / {BATCH}) AS BIGINT) AS batch_id FROM s)
SELECT batch_id, CAST(count(*) AS BIGINT) AS n, CAST(max(len(enc_input)) AS BIGINT) AS max_enc_len,
       CAST(max(len(oovs)) AS BIGINT) AS max_art_oovs,
       md5(string_agg(ex_key, ',' ORDER BY rn)) AS members_md5
FROM t GROUP BY batch_id
""")
def q_batches(spark, sf_dir):
    """T7 length-bucketed batches, E4/E5 padding, A18 batch maxima, E7 strings kept."""
    enc, _ = encoded(spark, sf_dir)
    b = bt.make_batches(enc, "ex_key", BATCH, CACHE, max_dec_steps=MAX_DEC)
    bad_pad = F.sum(F.when(F.size("enc_batch") != F.col("max_enc_len"), 1).otherwise(0))
    g = b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("enc_len").cast("long").alias("max_enc_len"),
                                  F.max(F.size("article_oovs")).cast("long").alias("max_art_oovs"),
                                  F.sort_array(F.collect_list(F.struct("slot", "ex_key"))).alias("m"), bad_pad.alias("bad"))
    g = g.withColumn("members_md5", F.md5(F.array_join(F.transform("m", lambda z: z["ex_key"]), ",")))
    g = g.withColumn("members_md5", F.when(F.col("bad") == 0, F.col("members_md5")).otherwise(
        F.raise_error(F.lit("padding length mismatch"))))
    return g.select("batch_id", "n", "max_enc_len", "max_art_oovs", "members_md5")
