"""Catalogue: metric log (W8-W10), sentence labels (J5, A16, A17), splits (U4,
T5), model scoring hooks (T4, M1-M4, T10, E6) over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import collection as co
from qsumm.operators import metric_log as ml
from qsumm.operators import rouge as rg
from qsumm.plans import examples as exs
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import PAIRS_SQL, query
from qsumm.sources.tables import table

PATIENCE = 5


@query("metric_smoothing", f"""
WITH RECURSIVE s AS (
  SELECT event_type AS series, ts, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events
),
r AS (
  SELECT series, rn, least(value, 12.0::DOUBLE) AS m, least(value, 12.0::DOUBLE) AS best, 0::BIGINT AS runs,
         true AS is_best FROM s WHERE rn = 1
  UNION ALL
  SELECT x.series, x.rn, x.m,
         CASE WHEN x.m < r.best THEN x.m ELSE r.best END,
         CASE WHEN x.m < r.best THEN 0 ELSE r.runs + 1 END,
         x.m < r.best
  FROM r JOIN (
    SELECT s.series, s.rn, s.value FROM s
  ) s2 ON s2.series = r.series AND s2.rn = r.rn + 1,
  LATERAL (SELECT s2.series, s2.rn,
           least(CASE WHEN r.m = 0 THEN s2.value ELSE r.m * 0.99::DOUBLE + (1.0::DOUBLE - 0.99::DOUBLE) * s2.value END,
                 12.0::DOUBLE) AS m) x
)
SELECT s.series AS event_type, s.ts, s.event_id, round(r.m, 6) AS smoothed, r.is_best, r.runs,
       r.runs > {PATIENCE} AS stop
FROM r JOIN s USING (series, rn)
""")
def q_metric_smoothing(spark, sf_dir):
    """W8 running mean (decay 0.99, clip 12), W9 best-so-far, W10 patience over the
    event stream as a metric log (series = event_type, ordered by ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    out = ml.metric_scan(ev, "event_type", ["ts", "event_id"], "value", patience=PATIENCE, chunk=512)
    return out.select("event_type", "ts", "event_id", F.round("smoothed", 6).alias("smoothed"), "is_best",
                      F.col("runs").cast("long").alias("runs"), "stop")


def labelled(spark, sf_dir):
    ex = exs.passage_examples(spark, sf_dir).withColumn("ref_sents", tx.sentences("summary"))
    return rg.sentence_labels(ex, "sents", "ref_sents", 0.9, "labels")


LABELS_SQL = f"""
{PAIRS_SQL.strip()},
ex AS (SELECT item_id, doc_id, ex_key, {sq.sentences('article')} AS sents, {sq.sentences('summary')} AS rs FROM pairs),
a AS (SELECT item_id, doc_id, ex_key, unnest(range(1, len(sents) + 1)) AS pos, unnest(sents) AS s FROM ex),
b AS (SELECT item_id, doc_id, unnest(rs) AS r FROM ex),
sa AS (SELECT *, {sq.rouge_tokens('s')} AS st FROM a),
sb AS (SELECT *, {sq.rouge_tokens('r')} AS rt FROM b),
sc AS (
  SELECT sa.item_id, sa.doc_id, sa.ex_key, sa.pos,
         max(CASE WHEN len(sa.st) > 0 THEN CAST({sq.lcs('sa.st', 'sb.rt')} AS DOUBLE) / len(sa.st) ELSE 0.0 END) AS best
  FROM sa LEFT JOIN sb USING (item_id, doc_id) GROUP BY sa.item_id, sa.doc_id, sa.ex_key, sa.pos
),
lab AS (SELECT *, CASE WHEN coalesce(best, 0) > 0.9 THEN 1 ELSE 0 END AS label FROM sc)"""


@query("sentence_labels", f"""
WITH {LABELS_SQL.strip()}
SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS n_sents, CAST(sum(label) AS BIGINT) AS n_positive,
       md5(string_agg(CAST(label AS VARCHAR), '' ORDER BY pos)) AS labels_md5
FROM lab GROUP BY item_id, doc_id
""")
def q_sentence_labels(spark, sf_dir):
    """J5 + A16 + A17: binary sentence labels (best ROUGE-L f against any summary
    sentence > 0.9), kept in sentence order."""
    lab = labelled(spark, sf_dir)
    return lab.select("item_id", "doc_id", F.size("labels").cast("long").alias("n_sents"),
                      F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_positive"),
                      F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), "")).alias("labels_md5"))


@query("label_split", f"""
WITH {PAIRS_SQL.strip()},
r AS (SELECT item_id, doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '13', ex_key)), ex_key) - 1 AS rnk,
             count(*) OVER () AS n FROM pairs)
SELECT item_id, doc_id, CASE WHEN rnk < CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM r
""")
def q_label_split(spark, sf_dir):
    """U4 + T5: seeded shuffle (seed 13) then the first int(0.8 n) examples train."""
    ex = exs.passage_examples(spark, sf_dir).select("item_id", "doc_id", "ex_key")
    return co.split_by_rank(ex, "ex_key", 13, 0.8).select("item_id", "doc_id", "split")


@query("topk_by_score", f"""
WITH {LABELS_SQL.strip()},
capped AS (SELECT * FROM sc WHERE pos <= 200),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY best DESC, pos) AS r FROM capped)
SELECT item_id, doc_id, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY r) AS picked
FROM rk WHERE r <= 3 GROUP BY item_id, doc_id
""")
def q_topk_by_score(spark, sf_dir):
    """T4: top-3 sentence positions by score among the first 200 (descending, low
    index first on ties), positions past the document end dropped."""
    from qsumm.operators.select import top_k_positions
    lab = rg.sentence_best_scores(exs.passage_examples(spark, sf_dir).withColumn("ref_sents", tx.sentences("summary")),
                                  "sents", "ref_sents", "scores")
    picked = top_k_positions("scores", F.size("sents"), 3, 200)
    return lab.select("item_id", "doc_id", F.array_join(F.transform(picked, lambda i: i.cast("string")), ",").alias("picked"))


@query("model_topk", f"""
WITH {PAIRS_SQL.strip()},
ex AS (SELECT item_id, doc_id, question, {sq.sentences('article')} AS sents FROM pairs),
a AS (SELECT item_id, doc_id, question, unnest(range(1, len(sents) + 1)) AS pos, unnest(sents) AS s FROM ex),
t AS (SELECT *, {sq.rouge_tokens('s')} AS st, {sq.rouge_tokens('question')} AS qt FROM a),
p AS (SELECT *, CASE WHEN len(st) > 0 THEN CAST(len(list_filter(st, lambda x: list_contains(qt, x))) AS DOUBLE) / len(st)
                     ELSE 0.0 END AS prob FROM t WHERE pos <= 200),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY prob DESC, pos) AS r FROM p)
SELECT item_id, doc_id, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY r) AS picked,
       md5(string_agg(s, ' ' ORDER BY r)) AS gen_md5
FROM rk WHERE r <= 3 GROUP BY item_id, doc_id
""")
def q_model_topk(spark, sf_dir):
    """M1 pluggable scorer in Arrow batches + T4 top-3 by probability -> summary."""
    from qsumm.operators import scoring as sc
    from qsumm.operators.select import top_k_positions
    ex = exs.passage_examples(spark, sf_dir).select("item_id", "doc_id", "question", "sents")
    scored = sc.score_sentences(ex, "question", "sents", sc.overlap_scorer, "probs")
    picked = scored.withColumn("picked", top_k_positions("probs", F.size("sents"), 3, 200))
    gen = F.array_join(F.transform("picked", lambda i: F.element_at("sents", i + 1)), " ")
    return picked.select("item_id", "doc_id", F.array_join(F.transform("picked", lambda i: i.cast("string")), ",").alias("picked"),
                         F.md5(gen).alias("gen_md5"))


@query("generated_summaries", f"""
WITH {PAIRS_SQL.strip()}
SELECT item_id, doc_id, md5(array_to_string(({sq.sentences('article')})[1:3], ' ')) AS gen_md5 FROM pairs
""")
def q_generated_summaries(spark, sf_dir):
    """M3 + T10: batched generation with a pluggable generator (default lead-3),
    every input row answered (alignment check inside the batch loop)."""
    from qsumm.operators import scoring as sc
    ex = exs.passage_examples(spark, sf_dir).select("item_id", "doc_id", "article", "question")
    gen = sc.generate(ex, "article", "question", sc.lead_generator)
    return gen.select("item_id", "doc_id", F.md5("gen").alias("gen_md5"))


@query("relevance_model")
def q_relevance_model(spark, sf_dir):
    """M2: relevance model trained on the A17 labels (80/20 split by U4), AUC on
    the validation part."""
    from qsumm.operators import scoring as sc
    lab = labelled(spark, sf_dir)
    split = co.split_by_rank(lab.select("ex_key"), "ex_key", 13, 0.8)
    rows = sc.sentence_rows(lab, "ex_key", "question", "sents", "labels").join(split, "ex_key")
    feats = sc.relevance_features(rows)
    train = feats.where(F.col("split") == "train")
    valid = feats.where(F.col("split") == "validation")
    model = sc.train_relevance(train, num_features=1 << 16, max_iter=20)
    auc = sc.evaluate_relevance(model, valid)
    pred = model.transform(valid).withColumn("p", sc.class1_probability())
    return pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"),
                                     F.lit(round(auc, 6)).alias("auc"))


RELEVANCE_FEATURES = ("overlap", "earliness", "log_length")


def relevance_rows(spark, sf_dir):
    """Labelled sentences with the fixed features of the checkable learner."""
    from qsumm.operators import scoring as sc
    lab = labelled(spark, sf_dir)
    split = co.split_by_rank(lab.select("ex_key"), "ex_key", 13, 0.8)
    rows = sc.sentence_rows(lab.select("item_id", "doc_id", "ex_key", "question", "sents", "labels"), "ex_key", "question",
                            "sents", "labels").join(split, "ex_key")
    st, qt = tx.rouge_tokens("sentence"), tx.rouge_tokens("question")
    n = F.size(st)
    return rows.select(
        "ex_key", "pos", "split", "label",
        F.when(n > 0, F.size(F.filter(st, lambda t: F.array_contains(qt, t))) / n).otherwise(F.lit(0.0)).alias("overlap"),
        (1.0 / (F.col("pos") + 1)).alias("earliness"), F.log(1.0 + n).alias("log_length"))


def _newton_sql(k: int) -> str:
    """The Newton steps as common table expressions: sums, Gauss-Jordan, next coefficients."""
    from qsumm.operators.newton import RIDGE, STEPS
    idx = range(k)
    out = ["b_0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in idx) + ")"]
    for t in range(STEPS):
        z = " + ".join(f"b{i} * x{i}" for i in idx)
        out.append(f"p_{t} AS (SELECT f.*, b.*, 1 / (1 + exp(-({z}))) AS p FROM feat f, b_{t} b WHERE split = 'train')")
        sums = [f"sum(p * (1 - p) * x{i} * x{j})" + (f" + {RIDGE}" if i == j else "") + f" AS m{i}{j}" for i in idx for j in idx]
        sums += [f"sum((y - p) * x{i}) - {RIDGE} * max(b{i}) AS m{i}{k}" for i in idx]
        sums += [f"max(b{i}) AS b{i}" for i in idx]
        out.append(f"g_{t}_0 AS (SELECT {', '.join(sums)} FROM p_{t})")
        for c in idx:
            cols = [f"m{i}{j}" if i == c else f"m{i}{j} - m{i}{c} * m{c}{j} / m{c}{c} AS m{i}{j}"
                    for i in idx for j in range(k + 1)]
            out.append(f"g_{t}_{c + 1} AS (SELECT {', '.join(cols + [f'b{i}' for i in idx])} FROM g_{t}_{c})")
        out.append(f"b_{t + 1} AS MATERIALIZED (SELECT " + ", ".join(f"b{i} + m{i}{k} / m{i}{i} AS b{i}" for i in idx)
                   + f" FROM g_{t}_{k})")
    return ",\n".join(out) + f",\nbeta AS (SELECT * FROM b_{STEPS})"


RELEVANCE_SQL = f"""
WITH {LABELS_SQL.strip()},
qx AS (SELECT ex_key, {sq.rouge_tokens('question')} AS qt FROM pairs),
sp AS (SELECT ex_key, row_number() OVER (ORDER BY md5(concat_ws('|', '13', ex_key)), ex_key) - 1 AS rnk,
              count(*) OVER () AS n FROM pairs),
feat AS MATERIALIZED (
  SELECT sa.item_id, sa.doc_id, sa.ex_key, sa.pos, sa.s, lab.label AS y,
         CASE WHEN rnk < CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'validation' END AS split, CAST(1 AS DOUBLE) AS x0,
         CASE WHEN len(st) > 0 THEN CAST(len(list_filter(st, lambda x: list_contains(qt, x))) AS DOUBLE) / len(st) ELSE 0.0 END AS x1,
         CAST(1 AS DOUBLE) / sa.pos AS x2, ln(CAST(1 AS DOUBLE) + len(st)) AS x3
  FROM sa JOIN lab ON lab.ex_key = sa.ex_key AND lab.pos = sa.pos JOIN qx ON qx.ex_key = sa.ex_key JOIN sp ON sp.ex_key = sa.ex_key
),
{_newton_sql(len(RELEVANCE_FEATURES) + 1)},
scored AS (SELECT f.*, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p FROM feat f, beta)"""


@query("relevance_newton", f"""
{RELEVANCE_SQL},
v AS (SELECT y, round(p, 9) AS s FROM scored WHERE split = 'validation'),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM v),
area AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS pos, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs FROM r)
SELECT round(b0, 6) AS intercept, round(b1, 6) AS overlap, round(b2, 6) AS earliness, round(b3, 6) AS log_length,
       CAST(n AS BIGINT) AS n_validation, CAST(pos AS BIGINT) AS n_positive,
       round((rs - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc
FROM area, beta
""")
def q_relevance_newton(spark, sf_dir):
    """M2, checkable: relevance model on the A17 labels by Newton steps; its
    coefficients, and the area under the curve of the validation part."""
    from qsumm.operators import newton as nw
    rows = relevance_rows(spark, sf_dir)
    beta = nw.fit_logistic(rows.where(F.col("split") == "train"), "label", RELEVANCE_FEATURES)
    scored = rows.where(F.col("split") == "validation").select(
        "label", F.round(nw.probability(beta, RELEVANCE_FEATURES), 9).alias("s"))
    names = ("intercept", *RELEVANCE_FEATURES)
    return nw.area_under_curve(scored, "s", "label").select(
        *[F.round(F.lit(b), 6).alias(n) for b, n in zip(beta, names)], F.col("n").alias("n_validation"), "n_positive",
        F.round("auc", 6).alias("auc"))


@query("relevance_topk", f"""
{RELEVANCE_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY ex_key ORDER BY round(p, 9) DESC, pos) AS r FROM scored WHERE pos <= 200)
SELECT item_id, doc_id, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY r) AS picked, string_agg(CAST(CAST(round(round(p, 9) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY r) AS scores_ppm,
       md5(string_agg(s, ' ' ORDER BY r)) AS gen_md5
FROM rk WHERE r <= 3 GROUP BY item_id, doc_id
""")
def q_relevance_topk(spark, sf_dir):
    """M1 with the M2 model: every sentence scored by a column expression inside its
    row, T4 top-3 among the first 200 with their scores, joined to a summary."""
    from qsumm.operators import newton as nw
    from qsumm.operators import select as sel
    rows = relevance_rows(spark, sf_dir)
    beta = nw.fit_logistic(rows.where(F.col("split") == "train"), "label", RELEVANCE_FEATURES)
    ex = exs.passage_examples(spark, sf_dir).select("item_id", "doc_id", "question", "sents")
    with_q = ex.withColumn("qt", tx.rouge_tokens("question"))

    def prob(sentence, pos):
        st = tx.rouge_tokens(sentence)
        n = F.size(st)
        overlap = F.when(n > 0, F.size(F.filter(st, lambda t: F.array_contains(F.col("qt"), t))) / n).otherwise(F.lit(0.0))
        z = (F.lit(beta[0]) + F.lit(beta[1]) * overlap + F.lit(beta[2]) * (1.0 / (pos + 1)) + F.lit(beta[3]) * F.log(1.0 + n))
        return F.round(1.0 / (1.0 + F.exp(-z)), 9)

    scored = with_q.withColumn("probs", F.transform("sents", prob))
    picked = scored.withColumn("picked", sel.top_k_positions("probs", F.size("sents"), 3, 200))
    return picked.select(
        "item_id", "doc_id", F.array_join(F.transform("picked", lambda i: i.cast("string")), ",").alias("picked"),
        F.array_join(F.transform("picked", lambda i: F.round(F.element_at("probs", i + 1) * 1_000_000).cast("long").cast("string")),
                     ",").alias("scores_ppm"),
        F.md5(F.array_join(F.transform("picked", lambda i: F.element_at("sents", i + 1)), " ")).alias("gen_md5"))


def _metric_sql():
    from qsumm.plans.catalog import ORACLE
    return ORACLE["metric_smoothing"]


@query("stream_metric_smoothing", _metric_sql())
def q_stream_metric_smoothing(spark, sf_dir):
    """The metric-log fold as a stateful stream over the events files
    (batch twin: ``metric_smoothing``)."""
    from qsumm.streaming.metric_stream import run_events_stream
    out = run_events_stream(spark, sf_dir, "events")
    return out.select(F.col("series").alias("event_type"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                      F.col("tie").alias("event_id"), F.round("smoothed", 6).alias("smoothed"), "is_best", "runs",
                      "stop")


def _stream_rouge_sql():
    from qsumm.plans.catalog import _baselines_sql, _rouge_eval_sql
    return f"""
WITH {_baselines_sql()},
{_rouge_eval_sql('gens')}
SELECT system, count(*) AS n, round(sum(r1) / count(*), 6) AS rouge_1, round(sum(r2r) / count(*), 6) AS rouge_2,
       round(sum(rl) / count(*), 6) AS rouge_l
FROM per_ex GROUP BY system
"""


@query("stream_rouge", _stream_rouge_sql())
def q_stream_rouge(spark, sf_dir):
    """Baseline predictions written as files, then scored as a stream with a
    running per-system aggregate (batch twin: ``system_rouge`` for 1/2/L)."""
    import uuid

    from qsumm.plans.catalog import baseline_predictions
    from qsumm.session import ensure_checkpoint_dir
    from qsumm.streaming.scoring_stream import run_prediction_stream
    src = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    baseline_predictions(spark, sf_dir).select("item_id", "doc_id", "system", "gen", "summary") \
        .write.parquet(src)
    return run_prediction_stream(spark, src, "rouge", files_per_trigger=4)
