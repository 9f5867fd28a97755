"""Catalogue: evaluation of the baseline predictions (A9-A15, A20, J10, J12,
F14, K5, W7) over the passage examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import bleu as bl
from qsumm.operators import collection as co
from qsumm.operators import rouge as rg
from qsumm.operators import stats as st
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import _baselines_sql, _rouge_eval_sql, baseline_predictions, query

PAIRS = [("best_rouge", "lead"), ("best_rouge", "random"), ("lead", "random")]


@query("fast_rouge", f"""
WITH {_baselines_sql()},
t AS (SELECT system, {sq.word_punct_tokens('gen')} AS ht, {sq.word_punct_tokens('summary')} AS rt FROM gens),
g AS (SELECT system, {sq.ngrams('ht', 2)} AS h2, {sq.ngrams('rt', 2)} AS r2 FROM t),
s AS (SELECT system, CASE WHEN len(r2) > 0 THEN CAST({sq.clipped_overlap('h2', 'r2')} AS DOUBLE) / len(r2) END AS fr FROM g)
SELECT system, CAST(count(fr) AS BIGINT) AS n_scored, round(avg(fr), 6) AS fast_rouge_2 FROM s GROUP BY system
""")
def q_fast_rouge(spark, sf_dir):
    """Macro ROUGE-2 recall over word/punctuation bigrams."""
    p = baseline_predictions(spark, sf_dir)
    p = p.withColumn("ht", tx.word_punct_tokens("gen")).withColumn("rt", tx.word_punct_tokens("summary"))
    s = rg.fast_rouge(p, "ht", "rt", 2)
    return s.groupBy("system").agg(F.count("fast_rouge").alias("n_scored"),
                                   F.round(F.avg("fast_rouge"), 6).alias("fast_rouge_2"))


@query("corpus_bleu", f"""
WITH {_baselines_sql()},
t AS (SELECT system, {sq.word_punct_tokens('gen')} AS ht, {sq.word_punct_tokens('summary')} AS rt FROM gens),
c AS (SELECT system, {sq.bleu_counts('ht', 'rt')} FROM t),
s AS (SELECT system, sum(b1_num) AS n1, sum(b1_den) AS d1, sum(b2_num) AS n2, sum(b2_den) AS d2,
             sum(b3_num) AS n3, sum(b3_den) AS d3, sum(b4_num) AS n4, sum(b4_den) AS d4,
             sum(b_c) AS sc, sum(b_r) AS sr FROM c GROUP BY system)
SELECT system, round({sq.bleu_expr(['n1', 'n2', 'n3', 'n4'], ['d1', 'd2', 'd3', 'd4'], 'sc', 'sr')}, 6) AS bleu,
       round(CASE WHEN sc > sr THEN 1.0 WHEN sc = 0 THEN 0.0 ELSE exp(1 - CAST(sr AS DOUBLE) / sc) END, 6) AS brevity_penalty,
       round(CAST(n1 AS DOUBLE) / d1, 6) AS p1, round(CAST(n2 AS DOUBLE) / d2, 6) AS p2,
       round(CAST(n3 AS DOUBLE) / d3, 6) AS p3, round(CAST(n4 AS DOUBLE) / d4, 6) AS p4
FROM s
""")
def q_corpus_bleu(spark, sf_dir):
    """Corpus BLEU-4 per system over word/punctuation tokens."""
    p = baseline_predictions(spark, sf_dir)
    c = bl.with_bleu_counts(p, tx.word_punct_tokens("gen"), tx.word_punct_tokens("summary"))
    return bl.corpus_bleu(c, "system")


@query("sentence_bleu_char", f"""
WITH {_baselines_sql()},
t AS (SELECT item_id, doc_id, system, {sq.characters('gen')} AS ht, {sq.characters('summary')} AS rt FROM gens),
c AS (SELECT item_id, doc_id, system, {sq.bleu_counts('ht', 'rt', sep="''")} FROM t)
SELECT item_id, doc_id, system,
       round({sq.bleu_expr(['b1_num', 'b2_num', 'b3_num', 'b4_num'], ['b1_den', 'b2_den', 'b3_den', 'b4_den'], 'b_c', 'b_r')}, 6)
         AS bleu_char
FROM c
""")
def q_sentence_bleu_char(spark, sf_dir):
    """Per-example BLEU over characters (the reference scores raw strings)."""
    p = baseline_predictions(spark, sf_dir)
    c = bl.with_bleu_counts(p, bl.characters("gen"), bl.characters("summary"), unit="char")
    s = bl.sentence_bleu(c, out="bleu_char")
    return s.select("item_id", "doc_id", "system", F.round("bleu_char", 6).alias("bleu_char"))


def _rouge_cols_sql():
    cols = []
    for n, name in (("1", "r1"), ("2", "r2r"), ("3", "r3r"), ("l", "rl")):
        cols.append(f"round({name}, 6) AS rouge_{n}_r")
    return ", ".join(cols)


@query("rouge_sheet", f"""
WITH {_baselines_sql()},
{_rouge_eval_sql('gens')}
SELECT item_id, doc_id, system, {_rouge_cols_sql()} FROM per_ex
""")
def q_rouge_sheet(spark, sf_dir):
    """Per-example ROUGE-1/2/3/L recall sheet."""
    p = baseline_predictions(spark, sf_dir)
    s = rg.with_rouge(p, "gen", "summary", max_n=3, alpha=1.0)
    return s.select("item_id", "doc_id", "system",
                    *[F.round(f"rouge_{n}_r", 6).alias(f"rouge_{n}_r") for n in ("1", "2", "3", "l")])


def _wilcoxon_sql(a, b):
    return f"""
SELECT '{a}' AS system_a, '{b}' AS system_b, CAST(count(*) AS BIGINT) AS n,
       round(coalesce(sum(CASE WHEN d > 0 THEN avg_rank ELSE 0 END), 0), 6) AS w_plus,
       round(coalesce(sum(CASE WHEN d < 0 THEN avg_rank ELSE 0 END), 0), 6) AS w_minus,
       round(coalesce(least(sum(CASE WHEN d > 0 THEN avg_rank ELSE 0 END), sum(CASE WHEN d < 0 THEN avg_rank ELSE 0 END)), 0), 6) AS t_stat,
       round(CASE WHEN count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - (SELECT coalesce(sum(c3), 0) FROM ties_{a}_{b}) / 48.0 > 0
             THEN (least(sum(CASE WHEN d > 0 THEN avg_rank ELSE 0 END), sum(CASE WHEN d < 0 THEN avg_rank ELSE 0 END))
                   - count(*) * (count(*) + 1) / 4.0)
                  / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0 - (SELECT coalesce(sum(c3), 0) FROM ties_{a}_{b}) / 48.0)
             END, 6) AS z,
       CAST((SELECT coalesce(sum(c3), 0) FROM ties_{a}_{b}) AS BIGINT) AS tie_term
FROM ranked_{a}_{b}"""


def _wilcoxon_ctes(a, b):
    return f"""
d_{a}_{b} AS (
  SELECT x.fr - y.fr AS d FROM fast x JOIN fast y USING (item_id, doc_id)
  WHERE x.system = '{a}' AND y.system = '{b}' AND x.fr - y.fr <> 0
),
ranked_{a}_{b} AS (
  SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS avg_rank,
         count(*) OVER (PARTITION BY abs(d)) AS c FROM d_{a}_{b}
),
ties_{a}_{b} AS (SELECT abs(d) AS ad, count(*) * count(*) * count(*) - count(*) AS c3 FROM d_{a}_{b} GROUP BY abs(d))"""


FAST_SQL = f"""
fast_tokens AS (SELECT *, {sq.word_punct_tokens('gen')} AS ht, {sq.word_punct_tokens('summary')} AS rt FROM gens),
fast_grams AS (SELECT *, {sq.ngrams('ht', 2)} AS h2, {sq.ngrams('rt', 2)} AS r2 FROM fast_tokens),
fast AS (SELECT item_id, doc_id, system,
                CASE WHEN len(r2) > 0 THEN CAST({sq.clipped_overlap('h2', 'r2')} AS DOUBLE) / len(r2) END AS fr
         FROM fast_grams)"""


@query("wilcoxon_rouge2", f"""
WITH {_baselines_sql()},
{FAST_SQL},
{','.join(_wilcoxon_ctes(a, b) for a, b in PAIRS)}
{' UNION ALL '.join(_wilcoxon_sql(a, b) for a, b in PAIRS)}
""")
def q_wilcoxon_rouge2(spark, sf_dir):
    """A15 + J12 + W7: signed-rank statistic of per-example fast ROUGE-2 (A12: word
    and punctuation bigrams) between systems."""
    from qsumm.session import cut_lineage
    p = baseline_predictions(spark, sf_dir)
    p = p.withColumn("ht", tx.word_punct_tokens("gen")).withColumn("rt", tx.word_punct_tokens("summary"))
    s = cut_lineage(rg.fast_rouge(p, "ht", "rt", 2).select("item_id", "doc_id", "system", "fast_rouge"))
    pairs = None
    for a, b in PAIRS:
        one = co.pair_systems(s, a, b, ["item_id", "doc_id"], "fast_rouge").withColumn("pair", F.lit(f"{a}|{b}"))
        pairs = one if pairs is None else pairs.unionByName(one)
    w = st.wilcoxon(pairs, group="pair")
    return w.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("system_a"),
                    F.split_part("pair", F.lit("|"), F.lit(2)).alias("system_b"), "n", "w_plus", "w_minus", "t_stat", "z",
                    "tie_term")


@query("prediction_alignment", f"""
WITH {_baselines_sql()},
a AS (SELECT item_id, doc_id FROM gens WHERE system = 'lead'),
b AS (SELECT item_id, doc_id FROM gens WHERE system = 'best_rouge')
SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS n_lead, CAST((SELECT count(*) FROM b) AS BIGINT) AS n_best,
       CAST((SELECT count(*) FROM a FULL OUTER JOIN b USING (item_id, doc_id) WHERE a.item_id IS NULL OR b.item_id IS NULL) AS BIGINT)
         AS n_unmatched
""")
def q_prediction_alignment(spark, sf_dir):
    """Predictions of two systems aligned by example key (unmatched = 0)."""
    p = baseline_predictions(spark, sf_dir).select("item_id", "doc_id", "system")
    a = p.where(F.col("system") == "lead")
    b = p.where(F.col("system") == "best_rouge")
    um = co.unmatched(a, b, ["item_id", "doc_id"])
    return (a.agg(F.count(F.lit(1)).alias("n_lead"))
            .join(b.agg(F.count(F.lit(1)).alias("n_best")), how="inner")
            .join(um.agg(F.count(F.lit(1)).alias("n_unmatched")), how="inner"))


B = 200


def _bootstrap_sql():
    weight = " + ".join(f"CAST(u >= {c!r} AS INTEGER)" for c in st.poisson1_cdf())
    metrics = [("r1", "rouge_1_r"), ("r2r", "rouge_2_r"), ("rl", "rouge_l_r")]
    wmeans = ", ".join(f"CASE WHEN sum(w) > 0 THEN sum({a} * w) / sum(w) END AS {n}" for a, n in metrics)
    qs = ", ".join(f"quantile_cont({n}, 0.025) AS {n}_lo, quantile_cont({n}, 0.975) AS {n}_hi" for _, n in metrics)
    point = ", ".join(f"avg({a}) AS {n}" for a, n in metrics)
    outs = ", ".join(f"round(p.{n}, 6) AS {n}, round(q.{n}_lo, 6) AS {n}_cb, round(q.{n}_hi, 6) AS {n}_ce"
                     for _, n in metrics)
    return f"""
WITH {_baselines_sql()},
{_rouge_eval_sql('gens')},
rep AS (
  SELECT e.system, e.r1, e.r2r, e.rl, b.b AS b,
         CAST(('0x' || substr(md5(concat_ws('|', '13', concat_ws(':', e.item_id, e.doc_id), CAST(b.b AS VARCHAR))), 1, 8))::BIGINT AS DOUBLE)
           / 4294967296.0 AS u
  FROM per_ex e, (SELECT unnest(range(1, {B + 1})) AS b) b
),
wts AS (SELECT *, {weight} AS w FROM rep),
means AS (SELECT system, b, {wmeans} FROM wts GROUP BY system, b),
q AS (SELECT system, {qs} FROM means GROUP BY system),
p AS (SELECT system, {point} FROM per_ex GROUP BY system)
SELECT p.system, {outs} FROM p JOIN q USING (system)
"""


@query("rouge_bootstrap", _bootstrap_sql())
def q_rouge_bootstrap(spark, sf_dir):
    """Poisson-bootstrap 95% interval of mean ROUGE-1/2/L recall per system
    (md5-seeded weights, reproducible in SQL)."""
    p = baseline_predictions(spark, sf_dir)
    s = rg.with_rouge(p, "gen", "summary", max_n=2, alpha=1.0)
    ms = ["rouge_1_r", "rouge_2_r", "rouge_l_r"]
    ci = st.bootstrap_ci(s, "system", "ex_key", ms, b=B)
    cols = ["system"]
    for m in ms:
        cols += [F.round(m, 6).alias(m), F.round(f"{m}_cb", 6).alias(f"{m}_cb"), F.round(f"{m}_ce", 6).alias(f"{m}_ce")]
    return ci.select(*cols)


def _wilcoxon_p_sql():
    """p from the one-row statistic: erfc(|z|/sqrt 2) by its Taylor series (below
    6-digit rounding error where the rounded p is not 0)."""
    x = "(abs(z) / sqrt(2.0))"
    series = (f"list_sum(list_transform(range(0, 80), lambda k: pow(-1.0, k) * pow({x}, 2 * k + 1) "
              f"/ (exp(lgamma(k + 1)) * (2 * k + 1))))")
    return f"""
WITH {_baselines_sql()},
{FAST_SQL},
{','.join(_wilcoxon_ctes(a, b) for a, b in PAIRS)},
w AS ({' UNION ALL '.join(_wilcoxon_sql(a, b) for a, b in PAIRS)})
SELECT *, round(CASE
    WHEN z IS NULL THEN NULL
    WHEN {x} > 4 THEN 0.0
    ELSE 1.0 - 2.0 / sqrt(pi()) * {series}
  END, 6) AS p_value
FROM w
"""


@query("wilcoxon_p", _wilcoxon_p_sql())
def q_wilcoxon_p(spark, sf_dir):
    """A15 p-value by the normal approximation with tie correction (one-row helper)."""
    w = st.with_p_value(q_wilcoxon_rouge2(spark, sf_dir), method="normal")
    return w.withColumn("p_value", F.round("p_value", 6))


def _lsum_sql():
    from qsumm.plans.catalog import _baselines_sql
    newrow = ("list_reduce(range(1, len(h) + 1), lambda row, j: list_append(row, CASE WHEN h[j] = x "
              "THEN acc[len(acc)][j] + 1 ELSE greatest(acc[len(acc)][j + 1], row[j]) END), [0::BIGINT])")
    return f"""
WITH RECURSIVE {_baselines_sql()},
hl AS (SELECT item_id, doc_id, system, unnest(range(1, len(string_split(gen, chr(10))) + 1)) AS hi,
              unnest(string_split(gen, chr(10))) AS line FROM gens),
rl AS (SELECT item_id, doc_id, system, unnest(range(1, len(string_split(summary, chr(10))) + 1)) AS ri,
              unnest(string_split(summary, chr(10))) AS line FROM gens),
ht AS (SELECT item_id, doc_id, system, hi, {sq.rouge_tokens('line')} AS h FROM hl),
rt AS (SELECT item_id, doc_id, system, ri, {sq.rouge_tokens('line')} AS r FROM rl),
prs AS (
  SELECT row_number() OVER () AS pid, r.item_id, r.doc_id, r.system, r.ri, r.r, h.h
  FROM rt r JOIN ht h USING (item_id, doc_id, system) WHERE len(r.r) > 0 AND len(h.h) > 0
),
tab AS (
  SELECT pid, r, h,
         list_reduce(r, lambda acc, x: list_append(acc, {newrow}),
                     [list_transform(range(0, len(h) + 1), lambda k: 0::BIGINT)]) AS t
  FROM prs
),
bt AS (
  SELECT pid, len(r) AS i, len(h) AS j, []::BIGINT[] AS marks FROM tab
  UNION ALL
  SELECT b.pid,
         CASE WHEN t.r[b.i] = t.h[b.j] THEN b.i - 1 WHEN t.t[b.i][b.j + 1] >= t.t[b.i + 1][b.j] THEN b.i - 1 ELSE b.i END,
         CASE WHEN t.r[b.i] = t.h[b.j] THEN b.j - 1 WHEN t.t[b.i][b.j + 1] >= t.t[b.i + 1][b.j] THEN b.j ELSE b.j - 1 END,
         CASE WHEN t.r[b.i] = t.h[b.j] THEN list_append(b.marks, b.i) ELSE b.marks END
  FROM bt b JOIN tab t USING (pid) WHERE b.i > 0 AND b.j > 0
),
ends AS (SELECT pid, marks FROM bt WHERE i = 0 OR j = 0),
umask AS (
  SELECT p.item_id, p.doc_id, p.system, p.ri, list_distinct(flatten(list(e.marks))) AS pos
  FROM ends e JOIN prs p USING (pid) GROUP BY p.item_id, p.doc_id, p.system, p.ri
),
marked AS (
  SELECT u.item_id, u.doc_id, u.system, r.r[x.p] AS tok, count(*) AS mc
  FROM umask u JOIN rt r USING (item_id, doc_id, system, ri), (SELECT unnest(u.pos) AS p) x
  GROUP BY u.item_id, u.doc_id, u.system, r.r[x.p]
),
hc AS (
  SELECT item_id, doc_id, system, tok, count(*) AS hcnt
  FROM (SELECT item_id, doc_id, system, unnest(h) AS tok FROM ht) GROUP BY item_id, doc_id, system, tok
),
hits AS (
  SELECT m.item_id, m.doc_id, m.system, sum(least(m.mc, coalesce(h.hcnt, 0))) AS hits
  FROM marked m LEFT JOIN hc h USING (item_id, doc_id, system, tok) GROUP BY m.item_id, m.doc_id, m.system
),
nr AS (SELECT item_id, doc_id, system, sum(len(r)) AS n_r FROM rt GROUP BY item_id, doc_id, system),
per AS (
  SELECT n.system, CASE WHEN n.n_r > 0 THEN CAST(coalesce(h.hits, 0) AS DOUBLE) / n.n_r ELSE 0.0 END AS rec
  FROM nr n LEFT JOIN hits h USING (item_id, doc_id, system)
)
SELECT system, count(*) AS n, round(avg(rec), 6) AS rouge_lsum FROM per GROUP BY system
"""


@query("system_rouge_lsum", _lsum_sql())
def q_system_rouge_lsum(spark, sf_dir):
    """A10/A11 summary level: union-LCS ROUGE-L recall per system (reference lines
    as sentences)."""
    p = baseline_predictions(spark, sf_dir)
    s = rg.with_rouge_lsum(p, "gen", "summary")
    return s.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rouge_lsum_r"), 6).alias("rouge_lsum"))
