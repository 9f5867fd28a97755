"""Query catalogue over the driver tables: Spark side and DuckDB oracle side.

Every query reads whole driver tables.  Doubles are built from integer
counters and rounded to 6 places on both sides; integer columns are BIGINT on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import rouge as rg
from qsumm.operators import select as sel
from qsumm.plans import examples as exs
from qsumm.plans import sqltext as sq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared SQL fragments

PAIRS_SQL = """
pairs AS (
  SELECT b.item_id, d.doc_id, b.text AS summary, b.text AS question, d.text AS article,
         concat_ws(':', b.item_id, d.doc_id) AS ex_key
  FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
)"""

K = 3


CONV_PAIRS_SQL = """
pairs AS (
  SELECT q.conv_id AS item_id, q.turn AS doc_id, '' AS summary, q.text AS question, a.text AS article,
         concat_ws(':', q.conv_id, q.turn) AS ex_key
  FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'
)"""


def _baselines_sql(pairs_sql: str = PAIRS_SQL) -> str:
    """CTEs ending in ``gens(item_id, doc_id, summary, system, gen)``."""
    return f"""
{pairs_sql},
ex AS (SELECT *, {sq.sentences('article')} AS sents FROM pairs),
sent AS (
  SELECT ex.item_id, ex.doc_id, ex.ex_key, ex.question, p.pos, ex.sents[p.pos] AS s
  FROM ex, unnest(range(1, len(ex.sents) + 1)) AS p(pos)
),
tok AS (SELECT *, {sq.rouge_tokens('s')} AS st, {sq.rouge_tokens('question')} AS qt FROM sent),
scored AS (SELECT *, {sq.ratio(sq.lcs('st', 'qt'), 'len(st)')} AS score FROM tok),
best_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, pos DESC) AS rk FROM scored
),
best AS (
  SELECT item_id, doc_id, string_agg(s, ' ' ORDER BY score, pos) AS gen
  FROM best_ranked WHERE rk <= {K} GROUP BY item_id, doc_id
),
rand_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, doc_id
         ORDER BY md5(concat_ws('|', '13', ex_key, CAST(pos AS VARCHAR))), pos) AS rk FROM sent
),
rand AS (
  SELECT r.item_id, r.doc_id,
         CASE WHEN len(e.sents) < {K} THEN array_to_string(e.sents, ' ')
              ELSE string_agg(r.s, ' ' ORDER BY r.rk) END AS gen
  FROM rand_ranked r JOIN ex e USING (item_id, doc_id)
  WHERE r.rk <= {K} OR len(e.sents) < {K}
  GROUP BY r.item_id, r.doc_id, e.sents
),
gens AS (
  SELECT item_id, doc_id, summary, 'lead' AS system, array_to_string(sents[1:{K}], ' ') AS gen FROM ex
  UNION ALL
  SELECT e.item_id, e.doc_id, e.summary, 'random', coalesce(r.gen, '') FROM ex e LEFT JOIN rand r USING (item_id, doc_id)
  UNION ALL
  SELECT e.item_id, e.doc_id, e.summary, 'best_rouge', coalesce(b.gen, '') FROM ex e LEFT JOIN best b USING (item_id, doc_id)
)"""


def _rouge_eval_sql(src: str, hyp: str = "gen", ref: str = "summary", keys: str = "system") -> str:
    """CTEs over ``src`` ending in ``per_ex`` with recall columns r1 r2 r3 rl."""
    return f"""
rtok AS (SELECT *, {sq.rouge_tokens(hyp)} AS ht, {sq.rouge_tokens(ref)} AS rt FROM {src}),
rgrams AS (SELECT *, {sq.ngrams('ht', 2)} AS h2, {sq.ngrams('rt', 2)} AS r2,
                     {sq.ngrams('ht', 3)} AS h3, {sq.ngrams('rt', 3)} AS r3 FROM rtok),
per_ex AS (
  SELECT *,
    {sq.ratio(sq.clipped_overlap('ht', 'rt'), sq.ngram_count('rt', 1))} AS r1,
    {sq.ratio(sq.clipped_overlap('h2', 'r2'), sq.ngram_count('rt', 2))} AS r2r,
    {sq.ratio(sq.clipped_overlap('h3', 'r3'), sq.ngram_count('rt', 3))} AS r3r,
    {sq.ratio(sq.lcs('ht', 'rt'), 'len(rt)')} AS rl
  FROM rgrams
)"""


# ---------------------------------------------------------------------------
# Flagship: baselines scored against the reference passage


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = exs.passage_examples(spark, sf_dir)
    return sel.baselines(ex, "ex_key", "sents", "question", k=K)


@query("system_rouge", f"""
WITH {_baselines_sql()},
{_rouge_eval_sql('gens')}
SELECT system, count(*) AS n, round(avg(r1), 6) AS rouge_1, round(avg(r2r), 6) AS rouge_2,
       round(avg(r3r), 6) AS rouge_3, round(avg(rl), 6) AS rouge_l
FROM per_ex GROUP BY system
""")
def q_system_rouge(spark, sf_dir):
    """T1-T3 + A9-A11: ROUGE-1/2/3/L recall of lead, random and best-overlap baselines."""
    preds = baseline_predictions(spark, sf_dir)
    scored = rg.with_rouge(preds, "gen", "summary", max_n=3, alpha=1.0)
    return rg.system_rouge(scored, keys=("system",))


@query("baseline_summaries", f"""
WITH {_baselines_sql()}
SELECT item_id, doc_id, system, md5(gen) AS gen_md5, CAST(length(gen) AS BIGINT) AS gen_len FROM gens
""")
def q_baseline_summaries(spark, sf_dir):
    """T1, T2, T3 outputs per example (K4 row form)."""
    preds = baseline_predictions(spark, sf_dir)
    return preds.select("item_id", "doc_id", "system", F.md5("gen").alias("gen_md5"),
                        F.length("gen").cast("long").alias("gen_len"))


@query("conversation_baselines", f"""
WITH {_baselines_sql(CONV_PAIRS_SQL)}
SELECT item_id AS conv_id, doc_id AS turn, system, md5(gen) AS gen_md5, CAST(length(gen) AS BIGINT) AS gen_len FROM gens
""")
def q_conversation_baselines(spark, sf_dir):
    """T1-T3 with J6 in its question-driven form: a user turn is the question,
    the following assistant turn the article; best-overlap sentences are the
    ones closest to the question."""
    ex = exs.conversation_examples(spark, sf_dir)
    ex = (ex.withColumn("ex_key", F.concat_ws(":", "conv_id", "turn"))
            .withColumn("sents", tx.sentences("article")))
    preds = sel.baselines(ex, "ex_key", "sents", "question", k=K, keep=["conv_id", "turn"])
    return preds.select("conv_id", "turn", "system", F.md5("gen").alias("gen_md5"),
                        F.length("gen").cast("long").alias("gen_len"))


@query("passage_match", """
SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
""")
def q_passage_match(spark, sf_dir):
    """Passage-in-document pairs."""
    return exs.passage_pairs(spark, sf_dir)


# Register the themed catalogues (they import ``query`` from here).
from qsumm.plans import catalog_text  # noqa: E402,F401
from qsumm.plans import catalog_stats  # noqa: E402,F401
from qsumm.plans import catalog_vocab  # noqa: E402,F401
from qsumm.plans import catalog_eval  # noqa: E402,F401
from qsumm.plans import catalog_model  # noqa: E402,F401
from qsumm.plans import catalog_xml  # noqa: E402,F401
from qsumm.plans import catalog_grid  # noqa: E402,F401
