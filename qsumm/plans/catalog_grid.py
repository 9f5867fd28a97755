"""Catalogue: comparison grid over tasks, summary types and systems (A11, K6, U2,
U3), per-example sheets with their texts (K5).

Tasks are the two example collections: ``page2answer`` (passage examples) and
``turn2answer`` (conversation examples, whose reference is the question).  Every
example has two references: the whole one (``single_abstractive``) and its first
sentence (``single_extractive``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import bleu as bl
from qsumm.operators import grid
from qsumm.operators import rouge as rg
from qsumm.operators import select as sel
from qsumm.plans import examples as exs
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import K, _baselines_sql, _rouge_eval_sql, baseline_predictions, query

DIMS = ["task", "summary_type", "system"]
SETS = [DIMS, ["task", "summary_type"], ["system"], []]
SCORES = {"rouge_1": "rouge_1_r", "rouge_2": "rouge_2_r", "rouge_3": "rouge_3_r", "rouge_l": "rouge_l_r",
          "fast_rouge_2": "fast_rouge"}

TASKS_SQL = """
pairs AS (
  SELECT 'p' || b.item_id AS item_id, d.doc_id, b.text AS summary, b.text AS question, d.text AS article,
         concat_ws(':', b.item_id, d.doc_id) AS ex_key
  FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
  UNION ALL
  SELECT 't' || q.conv_id, q.turn, q.text, q.text, a.text, concat_ws(':', q.conv_id, q.turn)
  FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'
)"""


def task_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task, summary_type, system, gen, summary)`` of the baselines on both tasks."""
    pages = exs.passage_examples(spark, sf_dir).select(
        F.lit("page2answer").alias("task"), "ex_key", "question", "summary", "sents")
    turns = exs.conversation_examples(spark, sf_dir).select(
        F.lit("turn2answer").alias("task"), F.concat_ws(":", "conv_id", "turn").alias("ex_key"), "question",
        F.col("question").alias("summary"), tx.sentences("article").alias("sents"))
    preds = sel.baselines(pages.unionByName(turns), "ex_key", "sents", "question", k=K, keep=["task", "summary"])
    first = F.coalesce(F.get(tx.sentences("summary"), F.lit(0)), F.lit(""))
    refs = F.array(F.struct(F.lit("single_abstractive").alias("summary_type"), F.col("summary")),
                   F.struct(F.lit("single_extractive").alias("summary_type"), first.alias("summary")))
    return preds.select("task", "system", "gen", F.explode(refs).alias("r")).select("task", "r.*", "system", "gen")


def _grid_sql() -> str:
    score = lambda c, name: f"round(avg({c}), 6) AS {name}"
    return f"""
WITH {_baselines_sql(TASKS_SQL)},
kinds AS (SELECT unnest(['single_abstractive', 'single_extractive']) AS summary_type),
refs AS (
  SELECT CASE WHEN item_id[1] = 'p' THEN 'page2answer' ELSE 'turn2answer' END AS task, summary_type, system, gen,
         CASE summary_type WHEN 'single_abstractive' THEN summary
              ELSE coalesce({sq.sentences('summary')}[1], '') END AS summary
  FROM gens, kinds
),
{_rouge_eval_sql('refs')},
wt AS (SELECT task, summary_type, system, r1, r2r, r3r, rl, {sq.word_punct_tokens('gen')} AS bh,
              {sq.word_punct_tokens('summary')} AS br FROM per_ex),
wg AS (SELECT *, {sq.ngrams('bh', 2)} AS f2, {sq.ngrams('br', 2)} AS g2 FROM wt),
c AS (SELECT task, summary_type, system, r1, r2r, r3r, rl,
             CASE WHEN len(g2) > 0 THEN CAST({sq.clipped_overlap('f2', 'g2')} AS DOUBLE) / len(g2) END AS fr,
             {sq.bleu_counts('bh', 'br')} FROM wg),
s AS (
  SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE task END AS task,
         CASE WHEN grouping(summary_type) = 1 THEN 'all' ELSE summary_type END AS summary_type,
         CASE WHEN grouping(system) = 1 THEN 'all' ELSE system END AS system,
         count(*) AS n, {score('r1', 'rouge_1')}, {score('r2r', 'rouge_2')}, {score('r3r', 'rouge_3')},
         {score('rl', 'rouge_l')}, {score('fr', 'fast_rouge_2')},
         sum(b1_num) AS n1, sum(b1_den) AS d1, sum(b2_num) AS n2, sum(b2_den) AS d2,
         sum(b3_num) AS n3, sum(b3_den) AS d3, sum(b4_num) AS n4, sum(b4_den) AS d4, sum(b_c) AS sc, sum(b_r) AS sr
  FROM c GROUP BY GROUPING SETS ((task, summary_type, system), (task, summary_type), (system), ())
)
SELECT task, summary_type, system, CAST(n AS BIGINT) AS n, rouge_1, rouge_2, rouge_3, rouge_l, fast_rouge_2,
       round({sq.bleu_expr(['n1', 'n2', 'n3', 'n4'], ['d1', 'd2', 'd3', 'd4'], 'sc', 'sr')}, 6) AS bleu
FROM s
"""


@query("results_grid", _grid_sql())
def q_results_grid(spark, sf_dir):
    """ROUGE means, fast ROUGE-2 and corpus BLEU of every (task,
    summary type, system), with the totals over systems and over tasks and types."""
    p = task_predictions(spark, sf_dir)
    p = rg.with_rouge(p, "gen", "summary", max_n=3, alpha=1.0)
    p = p.withColumns({"ht": tx.word_punct_tokens("gen"), "rt": tx.word_punct_tokens("summary")})
    p = bl.with_bleu_counts(rg.fast_rouge(p, "ht", "rt", 2), F.col("ht"), F.col("rt"))
    return grid.comparison_grid(p, DIMS, SETS, SCORES)


@query("example_sheet", f"""
WITH {_baselines_sql()},
t AS (SELECT *, {sq.word_punct_tokens('gen')} AS ht, {sq.word_punct_tokens('summary')} AS rt,
             {sq.characters('gen')} AS hc, {sq.characters('summary')} AS rc FROM gens),
g AS (SELECT *, {sq.ngrams('ht', 2)} AS h2, {sq.ngrams('rt', 2)} AS r2, {sq.bleu_counts('hc', 'rc', sep="''")} FROM t)
SELECT item_id, doc_id, system, summary AS gold, gen AS generated,
       round(CASE WHEN len(r2) > 0 THEN CAST({sq.clipped_overlap('h2', 'r2')} AS DOUBLE) / len(r2) END, 6) AS fast_rouge_2,
       round({sq.bleu_expr(['b1_num', 'b2_num', 'b3_num', 'b4_num'], ['b1_den', 'b2_den', 'b3_den', 'b4_den'], 'b_c', 'b_r')}, 6)
         AS bleu_char
FROM g
""")
def q_example_sheet(spark, sf_dir):
    """K5: the per-example sheet, gold and generated text beside fast ROUGE-2
    and character BLEU (A14)."""
    p = baseline_predictions(spark, sf_dir)
    p = p.withColumns({"ht": tx.word_punct_tokens("gen"), "rt": tx.word_punct_tokens("summary")})
    p = bl.with_bleu_counts(rg.fast_rouge(p, "ht", "rt", 2), bl.characters("gen"), bl.characters("summary"), unit="char")
    return bl.sentence_bleu(p, out="bleu_char").select(
        "item_id", "doc_id", "system", F.col("summary").alias("gold"), F.col("gen").alias("generated"),
        F.round("fast_rouge", 6).alias("fast_rouge_2"), F.round("bleu_char", 6).alias("bleu_char"))
