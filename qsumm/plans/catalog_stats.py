"""Catalogue: collection statistics and collection building (A1-A7, A21, J2, J3,
W1-W4, F4-F7, U1-U4) over whole driver tables.

Question-answer sheet fixture: one row per page; the question is the page
title (titles repeat), the url is the page url, the answer is the document
with ``doc_id = page_id``.  The requested section is written the way people
write them down, by the length of the title: the title itself, its first half in
capitals (found by containment only), a title no page has, or a missing marker.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from qsumm.functions import html as hf
from qsumm.functions import text as tx
from qsumm.functions import urls as uf
from qsumm.operators import collection as co
from qsumm.operators import stats as st
from qsumm.plans import examples as exs
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import PAIRS_SQL, query
from qsumm.plans.catalog_text import _markup_to_text_sql
from qsumm.sources.tables import table


def qa_sheet(spark, sf_dir):
    """``(a_pos, question, url, answer, section)`` one row per page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("answer"))
    sheet = pages.join(docs, "page_id", "left").select(
        F.col("page_id").alias("a_pos"), hf.page_title("html").alias("question"), uf.na_url("url").alias("url"), "answer")
    title, kind = F.col("question"), F.length("question") % 5
    written = (F.when(kind == 1, F.upper(F.substring(title, F.lit(1), F.ceil(F.length(title) / 2).cast("int"))))
               .when(kind == 2, F.concat(F.lit("About: "), title))
               .when(kind == 3, F.when(F.length(title) % 2 == 0, F.lit("none")).otherwise(F.lit("")))
               .otherwise(title))
    return sheet.withColumn("section", uf.na_section(written))


QA_SHEET_SQL = f"""
sheet0 AS (
  SELECT p.page_id AS a_pos,
         {_markup_to_text_sql("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS question,
         CASE WHEN p.url IN ('n/a', 'NA') THEN NULL ELSE p.url END AS url,
         d.text AS answer
  FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id
),
sheet1 AS (
  SELECT *, CASE length(question) % 5
              WHEN 1 THEN upper(substr(question, 1, CAST(ceil(length(question) / 2.0) AS INTEGER)))
              WHEN 2 THEN 'About: ' || question
              WHEN 3 THEN CASE WHEN length(question) % 2 = 0 THEN 'none' ELSE '' END
              ELSE question END AS written
  FROM sheet0
),
sheet AS (
  SELECT * EXCLUDE (written), CASE WHEN written NOT IN ('n/a', 'NA', 'none', '') THEN written END AS section FROM sheet1
)"""


def _raw_text_sql(x: str) -> str:
    """Extracted text of markup before white space is collapsed."""
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for k, v in hf.ENTITIES:
        v_sql = v.replace("'", "''")
        out = f"replace({out}, '{k}', '{v_sql}')"
    return out


def _site_sql(u):
    return (f"CASE WHEN string_split(split_part({u}, '//', 2), '.')[1] = 'www' "
            f"THEN string_split(split_part({u}, '//', 2), '.')[2] ELSE string_split(split_part({u}, '//', 2), '.')[1] END")


def _host_sql(u):
    return f"CASE WHEN instr({u}, '//') > 0 THEN split_part(split_part({u}, '//', 2), '/', 1) END"


@query("qa_sheet_stats", f"""
WITH {QA_SHEET_SQL.strip()},
t AS (SELECT *, {sq.word_punct_tokens('question')} AS qt, {sq.sentences('question')} AS qs,
             {sq.word_punct_tokens('answer')} AS atok, {sq.sentences('answer')} AS asn FROM sheet)
SELECT CAST(count(*) AS BIGINT) AS n_questions, CAST(count(*) AS BIGINT) AS n_answers,
       CAST(count(*) - count(DISTINCT question) AS BIGINT) AS q_match,
       round(avg(len(qt)), 6) AS avg_q_tokens, round(avg(len(qs)), 6) AS avg_q_sents,
       round(avg(len(atok)), 6) AS avg_a_tokens, round(avg(len(asn)), 6) AS avg_a_sents,
       CAST(count(DISTINCT coalesce(url, 'N/A')) AS BIGINT) AS unique_urls,
       CAST(count(DISTINCT coalesce({_site_sql('url')}, 'N/A')) AS BIGINT) AS unique_sites
FROM t
""")
def q_qa_sheet_stats(spark, sf_dir):
    """A1 duplicates, A2 per-row means, A3 unique urls and sites, P4 missing markers."""
    s = qa_sheet(spark, sf_dir)
    t = s.select("question", "url",
                 F.size(tx.word_punct_tokens("question")).alias("qt"), F.size(tx.sentences("question")).alias("qs"),
                 F.size(tx.word_punct_tokens("answer")).alias("at"), F.size(tx.sentences("answer")).alias("asn"))
    return t.agg(
        F.count(F.lit(1)).alias("n_questions"), F.count(F.lit(1)).alias("n_answers"),
        (F.count(F.lit(1)) - F.countDistinct("question")).alias("q_match"),
        F.round(F.avg("qt"), 6).alias("avg_q_tokens"), F.round(F.avg("qs"), 6).alias("avg_q_sents"),
        F.round(F.avg("at"), 6).alias("avg_a_tokens"), F.round(F.avg("asn"), 6).alias("avg_a_sents"),
        F.countDistinct(F.coalesce("url", F.lit("N/A"))).alias("unique_urls"),
        F.countDistinct(F.coalesce(uf.short_site("url"), F.lit("N/A"))).alias("unique_sites"))


@query("qa_grouped", f"""
WITH {QA_SHEET_SQL.strip()}
SELECT question, a_pos, CAST(row_number() OVER (PARTITION BY question ORDER BY a_pos) - 1 AS BIGINT) AS answer_rank,
       CAST(count(*) OVER (PARTITION BY question) AS BIGINT) AS n_answers
FROM sheet
""")
def q_qa_grouped(spark, sf_dir):
    """A1: answers grouped per question in sheet order, as a long table (rank of each
    answer inside its question); no question's answers are gathered in one row."""
    s = qa_sheet(spark, sf_dir).select("question", "a_pos")
    return co.rank_within(s, "question", "a_pos", "answer_rank").select(
        "question", F.col("a_pos").cast("long").alias("a_pos"), "answer_rank", "n_answers")


@query("site_histogram", f"""
SELECT {_site_sql('url')} AS site, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1
""")
def q_site_histogram(spark, sf_dir):
    """A4 + P2: pages per short site name, most frequent first."""
    p = table(spark, sf_dir, "pages").select(uf.short_site("url").alias("site"))
    return st.histogram(p, "site")


@query("host_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS n_answers, CAST(count(DISTINCT url) AS BIGINT) AS unique_urls,
       CAST(count(DISTINCT {_host_sql('url')}) AS BIGINT) AS unique_hosts
FROM pages
""")
def q_host_stats(spark, sf_dir):
    """A3 + P3 + U1: answers, unique urls, unique hosts."""
    p = table(spark, sf_dir, "pages").select("url", uf.host("url").alias("host"))
    return p.agg(F.count(F.lit(1)).alias("n_answers"), F.countDistinct("url").alias("unique_urls"),
                 F.countDistinct("host").alias("unique_hosts"))


def _stats_cols_sql(v, p):
    return (f"round(avg({v}), 6) AS {p}_mean, round(median({v}), 6) AS {p}_median, "
            f"round(stddev_pop({v}), 6) AS {p}_std")


COLLECTION_SQL = f"""
WITH {PAIRS_SQL.strip()},
conv AS (
  SELECT q.text AS question, a.text AS article FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user'
),
docs AS (
  SELECT 'conversation' AS dataset, 'question' AS doc_type, question AS txt FROM conv
  UNION ALL SELECT 'conversation', 'article', article FROM conv
  UNION ALL SELECT 'passage', 'summary', summary FROM pairs
  UNION ALL SELECT 'passage', 'article', article FROM pairs
),
c AS (SELECT dataset, doc_type, CAST(len({sq.word_punct_tokens('txt')}) AS DOUBLE) AS tok,
             CAST(len({sq.sentences('txt')}) AS DOUBLE) AS sen FROM docs)
"""


def collection_texts(spark, sf_dir):
    """``(dataset, doc_type, tok, sen)``: token and sentence counts of every text of the example sets."""
    conv = exs.conversation_examples(spark, sf_dir)
    pas = exs.passage_examples(spark, sf_dir)
    # one pass per example set: both texts of a row leave through one explode
    two = lambda df, a, b: df.select(F.explode(F.array(
        F.struct(F.lit(a).alias("doc_type"), F.col(a).alias("txt")),
        F.struct(F.lit(b).alias("doc_type"), F.col(b).alias("txt")))).alias("__d")).select("__d.*")
    docs = co.union_tagged({"conversation": two(conv, "question", "article"),
                            "passage": two(pas, "summary", "article")}, tag="dataset")
    return docs.select("dataset", "doc_type", F.size(tx.word_punct_tokens("txt")).cast("double").alias("tok"),
                    F.size(tx.sentences("txt")).cast("double").alias("sen"))


@query("collection_stats", f"""
{COLLECTION_SQL.strip()}
SELECT dataset, doc_type, CAST(count(*) AS BIGINT) AS n, {_stats_cols_sql('tok', 'tokens')},
       {_stats_cols_sql('sen', 'sents')}
FROM c GROUP BY dataset, doc_type
""")
def q_collection_stats(spark, sf_dir):
    """Count, mean, exact median, population std of tokens and sentences per
    (dataset, doc_type) (U2 union of the example sets)."""
    c = collection_texts(spark, sf_dir)
    agg = []
    for v, p in (("tok", "tokens"), ("sen", "sents")):
        agg += [F.round(F.avg(v), 6).alias(f"{p}_mean"), F.round(F.percentile(v, 0.5), 6).alias(f"{p}_median"),
                F.round(F.stddev_pop(v), 6).alias(f"{p}_std")]
    return c.groupBy("dataset", "doc_type").agg(F.count(F.lit(1)).alias("n"), *agg)


@query("collection_rollup", f"""
{COLLECTION_SQL.strip()}
SELECT CAST(2 - grouping(dataset) - grouping(doc_type) AS INTEGER) AS level, dataset, doc_type,
       CAST(count(*) AS BIGINT) AS n, {_stats_cols_sql('tok', 'tokens')}, {_stats_cols_sql('sen', 'sents')}
FROM c GROUP BY ROLLUP (dataset, doc_type)
""")
def q_collection_rollup(spark, sf_dir):
    """A6 per (dataset, document type), per dataset and over all texts, from counts per value."""
    c = collection_texts(spark, sf_dir)
    keys = ["dataset", "doc_type"]
    tok, sen = (st.rollup_describe(c, keys, v, p) for v, p in (("tok", "tokens"), ("sen", "sents")))
    same = [tok.level == sen.level, *[tok[k].eqNullSafe(sen[k]) for k in keys]]
    return tok.join(sen.withColumnRenamed("n", "__n"), same).select(
        tok.level, *[tok[k] for k in keys], "n", *[f"{p}_{m}" for p in ("tokens", "sents") for m in ("mean", "median", "std")])


@query("unique_article_stats", f"""
WITH prim AS (SELECT p.url, p.page_id, d.text AS article FROM pages p JOIN documents d ON d.doc_id = p.page_id),
firsts AS (SELECT url, arg_min(struct_pack(a := article), page_id).a AS article FROM prim GROUP BY url),
c AS (SELECT CAST(len({sq.word_punct_tokens('article')}) AS DOUBLE) AS tok,
             CAST(len({sq.sentences('article')}) AS DOUBLE) AS sen FROM firsts),
t AS (SELECT count(*) AS answers, count(DISTINCT url) AS urls, count(DISTINCT {_host_sql('url')}) AS sites FROM prim)
SELECT CAST(t.answers AS BIGINT) AS n_answers, CAST(t.urls AS BIGINT) AS unique_urls, CAST(t.sites AS BIGINT) AS unique_sites,
       CAST(count(tok) AS BIGINT) AS n, {_stats_cols_sql('tok', 'tokens')}, {_stats_cols_sql('sen', 'sents')}
FROM c, t GROUP BY t.answers, t.urls, t.sites
""")
def q_unique_article_stats(spark, sf_dir):
    """A7 + W2 keyed by url: answers, urls and sites, and the A6 statistics of the first
    article of every url (answers in the order of page ids)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.size(tx.word_punct_tokens("text")).cast("long").alias("tok"),
        F.size(tx.sentences("text")).cast("long").alias("sen"))
    prim = pages.join(docs, "page_id")
    firsts = co.first_by(prim, "url", "page_id", ["tok", "sen"])
    tok, sen = (st.rollup_describe(firsts, [], v, p) for v, p in (("tok", "tokens"), ("sen", "sents")))
    totals = prim.agg(F.count(F.lit(1)).alias("n_answers"), F.countDistinct("url").alias("unique_urls"),
                      F.countDistinct(uf.host("url")).alias("unique_sites"), F.lit(0).alias("level"))
    return totals.join(tok, "level").join(sen.drop("n"), "level").drop("level")


@query("unique_articles", f"""
WITH prim AS (
  SELECT {_host_sql('p.url')} AS host, p.page_id, d.text AS article
  FROM pages p JOIN documents d ON d.doc_id = p.page_id
),
firsts AS (SELECT host, arg_min(article, page_id) AS article, min(page_id) AS first_page FROM prim GROUP BY host)
SELECT host, CAST(first_page AS BIGINT) AS first_page, md5(article) AS article_md5,
       CAST(len({sq.word_punct_tokens('article')}) AS BIGINT) AS n_tokens,
       CAST(len({sq.sentences('article')}) AS BIGINT) AS n_sents
FROM firsts
""")
def q_unique_articles(spark, sf_dir):
    """W2 + A7: first article per host (answers ordered by page id) and its counts."""
    pages = table(spark, sf_dir, "pages").select("page_id", uf.host("url").alias("host"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("article"))
    prim = pages.join(docs, "page_id")
    firsts = co.first_by(prim, "host", "page_id", ["page_id", "article"])
    return firsts.select("host", F.col("page_id").cast("long").alias("first_page"), F.md5("article").alias("article_md5"),
                         F.size(tx.word_punct_tokens("article")).cast("long").alias("n_tokens"),
                         F.size(tx.sentences("article")).cast("long").alias("n_sents"))


VALIDATION_SQL = f"""
WITH {QA_SHEET_SQL.strip()},
firsts AS (SELECT question, min(a_pos) AS a_pos FROM sheet GROUP BY question),
f AS (SELECT s.* FROM sheet s JOIN firsts USING (question, a_pos)),
pg AS (SELECT page_id AS a_pos, {_markup_to_text_sql(f"regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')")} AS page_text FROM pages),
j AS (
  SELECT f.*, pg.page_text,
         {sq.collapse_ws('question')} || ' [QUESTION?] ' || {sq.collapse_ws('pg.page_text')} AS article,
         {sq.collapse_ws('answer')} AS summary
  FROM f JOIN pg USING (a_pos)
  WHERE pg.page_text IS NOT NULL AND length(pg.page_text) > 0
)"""


@query("validation_examples", f"""
{VALIDATION_SQL}
SELECT CAST(a_pos AS BIGINT) AS a_pos, question,
       length(summary) <= length(article) + 10 AS kept,
       md5({sq.tag_sentences(sq.sentences('summary'))}) AS tagged_summary_md5,
       CAST(length(article) AS BIGINT) AS article_len
FROM j
""")
def q_validation_examples(spark, sf_dir):
    """W1 first answer per question, F5 keep when a page text exists, P5, P10, P9
    tagged summary, F6 length rule as ``kept``: the set is the rows that have it true,
    null where there is no answer to measure."""
    return validation_candidates(spark, sf_dir).select(
        F.col("a_pos").cast("long").alias("a_pos"), "question", co.summary_fits("summary", "article").alias("kept"),
        F.md5(tx.tag_sentences(tx.sentences("summary"))).alias("tagged_summary_md5"),
        F.length("article").cast("long").alias("article_len"))


@query("validation_rejects", f"""
{VALIDATION_SQL}
SELECT CAST(a_pos AS BIGINT) AS a_pos, question, CAST(length(summary) AS BIGINT) AS summary_len,
       CAST(length(article) AS BIGINT) AS article_len
FROM j WHERE length(summary) > length(article) + 10
""")
def q_validation_rejects(spark, sf_dir):
    """F6 side table: first answers that are longer than their question-driven page."""
    out = validation_candidates(spark, sf_dir).where(~co.summary_fits("summary", "article"))
    return out.select(F.col("a_pos").cast("long").alias("a_pos"), "question",
                      F.length("summary").cast("long").alias("summary_len"),
                      F.length("article").cast("long").alias("article_len"))


def validation_candidates(spark, sf_dir):
    """``(a_pos, question, article, summary)`` before the length rule."""
    sheet = qa_sheet(spark, sf_dir)
    firsts = co.first_by(sheet, "question", "a_pos", ["a_pos", "answer"])
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("a_pos"), hf.html_text("html").alias("page_text"))
    j = firsts.join(pages, "a_pos").where(F.col("page_text").isNotNull() & (F.length("page_text") > 0))
    return j.select("a_pos", "question",
                    tx.with_question(tx.collapse_ws("question"), tx.collapse_ws("page_text")).alias("article"),
                    tx.collapse_ws("answer").alias("summary"))


PAGE_ANSWERS_SQL = f"""
urls AS (SELECT DISTINCT url FROM sheet WHERE url IS NOT NULL),
sel0 AS (SELECT p.* FROM pages p WHERE p.url IN (SELECT url FROM urls)),
sel AS (SELECT url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM sel0 GROUP BY url),
pg AS (
  SELECT url, page_id,
         string_split(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'),
                      '(?i)<h[1-6][^>]*>', chr(1), 'g'), chr(1))[2:] AS secs
  FROM sel
),
secs AS (
  SELECT url, page_id,
         list_transform(secs, lambda p: {{'title': {_markup_to_text_sql("regexp_extract(p, '(?is)^(.*?)</h[1-6]', 1)")},
                                         'raw': regexp_replace(p, '(?is)^.*?</h[1-6]\\s*>', '')}}) AS s
  FROM pg
),
j AS (SELECT a.a_pos, a.question, a.answer, a.section, x.page_id, x.s FROM sheet a LEFT JOIN secs x USING (url)),
m AS (
  SELECT *, list_filter(s, lambda z: z.title = section) AS exact,
         list_filter(s, lambda z: contains(lower(z.title), lower(section))) AS loose
  FROM j
),
pick0 AS (
  SELECT *, CASE WHEN section IS NULL THEN NULL WHEN len(exact) > 0 THEN exact[1] ELSE loose[1] END AS hit FROM m
),
pick AS (SELECT *, length(SECTION_LENGTH) AS section_len FROM pick0)""".replace("SECTION_LENGTH", _raw_text_sql("hit.raw"))


@query("page_answers", f"""
WITH {QA_SHEET_SQL.strip()},
{PAGE_ANSWERS_SQL}
SELECT CAST(a_pos AS BIGINT) AS a_pos, CAST(page_id AS BIGINT) AS page_id,
       CASE WHEN section IS NULL THEN 'missing' WHEN len(exact) > 0 THEN 'exact' WHEN len(loose) > 0 THEN 'contains'
            ELSE 'none' END AS match_kind,
       CAST(section_len AS BIGINT) AS section_len,
       hit.raw IS NOT NULL AND section_len >= length(answer) AS section_long_enough
FROM pick
""")
def q_page_answers(spark, sf_dir):
    """J3 semi join of pages on answer urls, J2 answers x pages on url, J4/P29/P30
    section pick (exact title, else case-insensitive containment), P4/F4 missing
    sections, F2 length rule on the section's extracted text."""
    m = page_answer_matches(spark, sf_dir)
    return m.select(F.col("a_pos").cast("long").alias("a_pos"), F.col("page_id").cast("long").alias("page_id"),
                    "match_kind", F.col("section_len").cast("long").alias("section_len"),
                    (F.col("hit.raw").isNotNull() & long_enough()).alias("section_long_enough"))


def long_enough():
    """the section's extracted text, white space not yet collapsed, is no shorter than the answer."""
    return F.col("section_len") >= F.length("answer")


def section_text():
    return F.when(F.col("hit.raw").isNotNull() & long_enough(), hf.markup_to_text("hit.raw"))


def page_answer_matches(spark, sf_dir):
    from qsumm.operators import sections as secs
    sheet = qa_sheet(spark, sf_dir)
    pages = co.pages_for_urls(table(spark, sf_dir, "pages"), sheet.select("url").distinct())
    # several pages with one url: the last one read (largest page id) wins
    pages = co.dedup_pages(pages.select("url", "page_id", "html"), "url", "page_id")
    pages = pages.select("url", "page_id", hf.html_sections_raw("html").alias("s"), hf.html_text("html").alias("page_text"))
    j = co.answers_with_pages(sheet, pages)
    return secs.pick_section(j, "s", "section").withColumn("section_len", F.length(hf.raw_text("hit.raw")))


SECTION_VALIDATION_SQL = f"""
WITH {QA_SHEET_SQL.strip()},
{PAGE_ANSWERS_SQL},
firsts AS (SELECT question, min(a_pos) AS a_pos FROM sheet GROUP BY question),
f AS (SELECT p.* FROM pick p JOIN firsts USING (question, a_pos)),
k AS (
  SELECT *, CASE WHEN hit.raw IS NOT NULL AND section_len >= length(answer)
                 THEN {_markup_to_text_sql('hit.raw')} END AS section_text
  FROM f
),
v AS (
  SELECT a_pos, question,
         {sq.collapse_ws('question')} || ' [QUESTION?] ' || {sq.collapse_ws('section_text')} AS article,
         {sq.collapse_ws('answer')} AS summary
  FROM k WHERE section_text IS NOT NULL
)"""


@query("section_validation", f"""
{SECTION_VALIDATION_SQL}
SELECT CAST(a_pos AS BIGINT) AS a_pos, question,
       md5({sq.tag_sentences(sq.sentences('summary'))}) AS tagged_summary_md5,
       CAST(length(article) AS BIGINT) AS article_len
FROM v WHERE length(summary) <= length(article) + 10
""")
def q_section_validation(spark, sf_dir):
    """Section-to-answer validation set: W1 first answer per question, F5 kept only
    when that answer has a matched section passing F2, P5 whitespace, P10
    question-driven article, F6 length rule (longer summaries go), P9 tagged summary."""
    kept = section_candidates(spark, sf_dir).where(co.summary_fits("summary", "article"))
    return kept.select(F.col("a_pos").cast("long").alias("a_pos"), "question",
                       F.md5(tx.tag_sentences(tx.sentences("summary"))).alias("tagged_summary_md5"),
                       F.length("article").cast("long").alias("article_len"))


def section_candidates(spark, sf_dir):
    """``(a_pos, question, article, summary)`` before the length rule."""
    m = page_answer_matches(spark, sf_dir)
    firsts = co.first_by(qa_sheet(spark, sf_dir).select("question", "a_pos"), "question", "a_pos", ["a_pos"])
    k = m.join(firsts, ["question", "a_pos"]).withColumn("section_text", section_text()).where(
        F.col("section_text").isNotNull())
    return k.select("a_pos", "question",
                    tx.with_question(tx.collapse_ws("question"), tx.collapse_ws("section_text")).alias("article"),
                    tx.collapse_ws("answer").alias("summary"))


@query("section_match_stats", f"""
WITH {QA_SHEET_SQL.strip()},
{PAGE_ANSWERS_SQL},
pt AS (SELECT page_id, {_markup_to_text_sql("regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')")} AS page_text FROM pages),
k AS (
  SELECT p.*, pt.page_text,
         CASE WHEN hit.raw IS NOT NULL AND section_len >= length(answer) THEN {_markup_to_text_sql('hit.raw')} END AS section_text
  FROM pick p LEFT JOIN pt USING (page_id)
)
SELECT CAST(count(*) AS BIGINT) AS n_answers,
       CAST(count(page_id) AS BIGINT) AS n_page_matches,
       CAST(count(section_text) AS BIGINT) AS n_section_matches,
       round(avg(CASE WHEN page_id IS NOT NULL THEN len({sq.sentences('page_text')}) END), 6) AS page_sents_mean,
       round(avg(CASE WHEN page_id IS NOT NULL THEN len({sq.word_punct_tokens('page_text')}) END), 6) AS page_tokens_mean,
       round(avg(CASE WHEN section_text IS NOT NULL THEN len({sq.sentences('section_text')}) END), 6) AS section_sents_mean,
       round(avg(CASE WHEN section_text IS NOT NULL THEN len({sq.word_punct_tokens('section_text')}) END), 6) AS section_tokens_mean,
       CAST(sum(CASE WHEN section_text IS NOT NULL AND NOT (length(page_text) > length(answer)
                AND length(page_text) > length(section_text)) THEN 1 ELSE 0 END) AS BIGINT) AS sanity_violations
FROM k
""")
def q_section_match_stats(spark, sf_dir):
    """A5 page/section match counts and means, F2 length rule, F7 sanity violations."""
    m = page_answer_matches(spark, sf_dir)
    k = m.withColumn("section_text", section_text())
    has_page = F.col("page_id").isNotNull()
    has_sec = F.col("section_text").isNotNull()
    bad = has_sec & ~((F.length("page_text") > F.length("answer")) & (F.length("page_text") > F.length("section_text")))
    return k.agg(
        F.count(F.lit(1)).alias("n_answers"), F.count("page_id").alias("n_page_matches"),
        F.count("section_text").alias("n_section_matches"),
        F.round(F.avg(F.when(has_page, F.size(tx.sentences("page_text")))), 6).alias("page_sents_mean"),
        F.round(F.avg(F.when(has_page, F.size(tx.word_punct_tokens("page_text")))), 6).alias("page_tokens_mean"),
        F.round(F.avg(F.when(has_sec, F.size(tx.sentences("section_text")))), 6).alias("section_sents_mean"),
        F.round(F.avg(F.when(has_sec, F.size(tx.word_punct_tokens("section_text")))), 6).alias("section_tokens_mean"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("sanity_violations"))


@query("sentence_units", f"""
WITH s AS (SELECT unnest({sq.sentences('text')}) AS sent FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_sentences, round(avg(len({sq.ws_tokens('sent')})), 6) AS units_per_sentence FROM s
""")
def q_sentence_units(spark, sf_dir):
    """Average whitespace units per sentence over every document sentence."""
    d = table(spark, sf_dir, "documents").select(F.explode(tx.sentences("text")).alias("sent"))
    return d.agg(F.count(F.lit(1)).alias("n_sentences"),
                 F.round(F.avg(F.size(tx.ws_tokens("sent"))), 6).alias("units_per_sentence"))


@query("embedding_profile", """
WITH p AS (
  SELECT label, CASE WHEN list_bool_and(list_transform(embedding, lambda x: NOT (isnan(x) OR isinf(x)))) THEN 'all_finite'
                     WHEN list_bool_and(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) THEN 'all_nonfinite'
                     ELSE 'some_nonfinite' END AS profile
  FROM embeddings
)
SELECT label, profile, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY label, profile
""")
def q_embedding_profile(spark, sf_dir):
    """Finite-value profile of every vector, counted per label."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("label", st.finite_profile(e, "embedding").alias("profile"))
    return p.groupBy("label", "profile").agg(F.count(F.lit(1)).alias("n"))


@query("example_ids", """
SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS ex_id
FROM conversations WHERE role = 'user'
""")
def q_example_ids(spark, sf_dir):
    """Consecutive example ids in (conversation, turn) order, no global window."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn")
    return co.dense_ids(c, ["conv_id", "turn"], "ex_id")
