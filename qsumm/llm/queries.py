"""Registered queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, contamination, cover, graph_ann, jaccard, language, mixing, packing, quality, run_index,
               toxicity, warc, whitening)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = graph_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are left without repeated 400-byte strings."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return run_index.dedup(docs)


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as segmented WARC archives and read back."""
    path = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest",
                                                  "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
b AS (SELECT *, list_aggregate(list_transform(string_split(x, ''), lambda c:
        lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + list_sum(list_transform(range(5), lambda j:
                  CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS BIGINT) * CAST(pow(2, 4 - j) AS BIGINT)))::BIGINT,
                1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 is held out of the fitting."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 0 of 5 is held out of the fitting."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(language.fold(F.col("doc_id"), 5) != 0))
    held_out = language.fold(F.col("doc_id"), 5) == 0
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and the divergence verdict of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    q = quality.judge(docs).select("doc_id", "quality.*")
    return q.select("doc_id", *quality.METRICS, "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into token pieces and packed into sequences of 4096."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32",
                                               "sequence_id", "offset")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document under the default source weights."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 75 percent shingle similarity."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.cluster(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""


def op10_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without repeated 35-word windows."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return cover.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k
        FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN rep USING (k), unnest(range(35)) AS u(j)),
wd AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT wd.doc_id, count(gone.p) AS n_removed,
                string_agg(word, ' ' ORDER BY wd.p) FILTER (WHERE gone.p IS NULL) AS k
         FROM wd LEFT JOIN gone ON wd.doc_id = gone.doc_id AND wd.p = gone.p GROUP BY wd.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of all vectors on the eight leading components."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.decontaminate(docs, _read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, CAST(least(len(w), 10) AS BIGINT) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
      FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM q),
v AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM d, l, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT DISTINCT v.doc_id, v.i, v.n, q.item FROM v JOIN q ON q.k = v.k AND q.n = v.n),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(n)) AS t(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of every language."""
    return collocations.top_phrases(_read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS (SELECT lang, k, w[i:i + k - 1] AS words FROM p, unnest([1, 2, 3, 4]) AS u(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS (SELECT lang, k, words, count(*) AS f FROM g GROUP BY lang, k, words),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.words, c.f AS a, j, u.f AS l, v.f AS r,
             CAST(2000000::HUGEINT * c.f // (u.f + v.f) AS BIGINT) AS score
      FROM c, unnest(range(1, c.k)) AS q(j)
      JOIN f u ON u.lang = c.lang AND u.words = c.words[:j] JOIN f v ON v.lang = c.lang AND v.words = c.words[j + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, j) AS o FROM x),
m AS (SELECT lang, words[i:i + k2 - 1] AS words, max(f) AS longest
      FROM c, unnest([2, 3]) AS u(k2), unnest(range(1, k - k2 + 2)) AS q(i) WHERE k2 < k GROUP BY 1, 2),
z AS (SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN m USING (lang, words)
      WHERE o = 1 AND (longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

QUERIES = {
    "op1_graph_ann": op1_graph_ann,
    "op2_run_index_dedup": op2_run_index_dedup,
    "op3_warc_segments": op3_warc_segments,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_shingle_join": op9_shingle_join,
    "op10_cover_dedup": op10_cover_dedup,
    "op11_jacobi_whitening": op11_jacobi_whitening,
    "op12_prefix_decontamination": op12_prefix_decontamination,
    "op13_tiled_collocations": op13_tiled_collocations,
}
ORACLE: dict[str, str] = {
    "op3_warc_segments": OP3_SQL,
    "op9_shingle_join": OP9_SQL,
    "op10_cover_dedup": OP10_SQL,
    "op12_prefix_decontamination": OP12_SQL,
    "op13_tiled_collocations": OP13_SQL,
}
