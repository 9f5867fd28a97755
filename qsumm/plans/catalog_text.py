"""Catalogue: text, url and page functions (P1-P28) over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from qsumm.functions import html as hf
from qsumm.functions import text as tx
from qsumm.functions import urls as uf
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import query
from qsumm.sources.tables import table

L = "CAST({} AS BIGINT)"


def _len(x):
    return L.format(f"len({x})")


@query("doc_text_profile", f"""
WITH t AS (
  SELECT doc_id, text, {sq.sentences('text')} AS sents, {sq.ws_tokens('text')} AS wt,
         {sq.rouge_tokens('text')} AS rt, {sq.word_punct_tokens('text')} AS pt FROM documents
)
SELECT doc_id, {_len('sents')} AS n_sents, {_len('wt')} AS n_ws_tokens, {_len('rt')} AS n_rouge_tokens,
       {_len('pt')} AS n_word_punct,
       md5({sq.strip_ws(sq.collapse_ws('text'))}) AS norm_md5,
       md5(array_to_string(sents, chr(10))) AS sents_md5,
       md5(array_to_string(pt, ' ')) AS tokens_md5
FROM t
""")
def q_doc_text_profile(spark, sf_dir):
    """P5, P6, P8, P14, P15, P16 on every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = d.select("doc_id", "text", tx.sentences("text").alias("sents"), tx.ws_tokens("text").alias("wt"),
                 tx.rouge_tokens("text").alias("rt"), tx.word_punct_tokens("text").alias("pt"))
    return t.select(
        "doc_id",
        F.size("sents").cast("long").alias("n_sents"),
        F.size("wt").cast("long").alias("n_ws_tokens"),
        F.size("rt").cast("long").alias("n_rouge_tokens"),
        F.size("pt").cast("long").alias("n_word_punct"),
        F.md5(tx.strip_ws(tx.collapse_ws("text"))).alias("norm_md5"),
        F.md5(F.array_join("sents", "\n")).alias("sents_md5"),
        F.md5(F.array_join("pt", " ")).alias("tokens_md5"),
    )


@query("doc_ngrams", f"""
WITH t AS (SELECT doc_id, {sq.rouge_tokens('text')} AS rt FROM documents),
g AS (SELECT doc_id, {sq.ngrams('rt', 2)} AS g2, {sq.ngrams('rt', 3)} AS g3 FROM t)
SELECT doc_id, {_len('g2')} AS n_bigrams, {_len('list_distinct(g3)')} AS n_distinct_trigrams,
       md5(array_to_string(g2, ' ')) AS bigrams_md5
FROM g
""")
def q_doc_ngrams(spark, sf_dir):
    """P17 n-grams (joined with ``_``) over ROUGE tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.rouge_tokens("text").alias("rt"))
    g = d.select("doc_id", tx.ngrams("rt", 2).alias("g2"), tx.ngrams("rt", 3).alias("g3"))
    return g.select("doc_id", F.size("g2").cast("long").alias("n_bigrams"),
                    F.size(F.array_distinct("g3")).cast("long").alias("n_distinct_trigrams"),
                    F.md5(F.array_join("g2", " ")).alias("bigrams_md5"))


@query("summary_tagging", f"""
WITH t AS (
  SELECT item_id, text, {sq.sentences('text')} AS sents,
         {sq.sentences("text || ' [END]'")} AS sents_end FROM benchmark
),
u AS (SELECT *, {sq.tag_sentences('sents')} AS tagged, {sq.tag_sentences('sents_end')} AS tagged_end FROM t),
v AS (
  SELECT *, list_transform(regexp_extract_all(tagged, '(?s)<s>(.*?)</s>', 1), lambda s: {sq.strip_ws('s')}) AS back
  FROM u
)
SELECT item_id,
       md5(tagged) AS tagged_md5,
       md5(tagged_end) AS tagged_end_md5,
       md5({sq.remove_tags('tagged')}) AS untagged_md5,
       {_len('back')} AS n_back,
       (back = sents) AS roundtrip,
       md5(array_to_string(back, '. ')) AS reference_md5,
       md5(array_to_string(list_transform(string_split(text, '.'), lambda s: '<s> ' || s || ' </s>'), ' ')) AS naive_md5,
       md5(replace(replace(text, '<', '&lt;'), '>', '&gt;')) AS html_safe_md5,
       md5(replace(text, chr(10), ' ') || ' [QUESTION?] ' || text) AS qdriven_md5
FROM v
""")
def q_summary_tagging(spark, sf_dir):
    """P7, P9, P10, P11, P12, P18, P19, P21, P25 on every benchmark passage."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    t = (b.withColumn("sents", tx.sentences("text"))
          .withColumn("sents_end", tx.sentences(tx.with_end_tag("text")))
          .withColumn("tagged", tx.tag_sentences("sents"))
          .withColumn("tagged_end", tx.tag_sentences("sents_end"))
          .withColumn("back", tx.tagged_sentences("tagged")))
    return t.select(
        "item_id",
        F.md5("tagged").alias("tagged_md5"),
        F.md5("tagged_end").alias("tagged_end_md5"),
        F.md5(tx.remove_tags("tagged")).alias("untagged_md5"),
        F.size("back").cast("long").alias("n_back"),
        (F.col("back") == F.col("sents")).alias("roundtrip"),
        F.md5(tx.join_reference("back")).alias("reference_md5"),
        F.md5(tx.naive_tag("text")).alias("naive_md5"),
        F.md5(tx.html_safe("text")).alias("html_safe_md5"),
        F.md5(tx.with_question(tx.newline_to_space("text"), "text")).alias("qdriven_md5"),
    )


def _fix_period_sql(x: str) -> str:
    ends = ", ".join("'" + e.replace("'", "''") + "'" for e in tx.END_TOKENS)
    return (f"CASE WHEN instr({x}, '@highlight') > 0 THEN {x} WHEN {x} = '' THEN {x} "
            f"WHEN right({x}, 1) IN ({ends}) THEN {x} ELSE {x} || '.' END")


@query("story_lines", f"""
WITH l AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: {sq.strip_ws('s')}) AS lines FROM documents
),
f AS (SELECT doc_id, lines, list_transform(lines, lambda x: {_fix_period_sql('x')}) AS fixed FROM l)
SELECT doc_id, {_len('lines')} AS n_lines,
       CAST(len(list_filter(range(1, len(lines) + 1), lambda i: lines[i] <> fixed[i])) AS BIGINT) AS n_fixed,
       md5(array_to_string(fixed, chr(10))) AS fixed_md5
FROM f
""")
def q_story_lines(spark, sf_dir):
    """S10 line form + P22: stripped lines, missing final periods added."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.transform(F.split("text", "\n", -1), tx.strip_ws)
    f = d.select("doc_id", lines.alias("lines")).withColumn("fixed", F.transform("lines", tx.fix_missing_period))
    changed = F.size(F.filter(F.arrays_zip("lines", "fixed"), lambda z: z["lines"] != z["fixed"]))
    return f.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                    changed.cast("long").alias("n_fixed"),
                    F.md5(F.array_join("fixed", "\n")).alias("fixed_md5"))


@query("decoded_regroup", f"""
WITH w AS (SELECT item_id, {sq.word_punct_tokens('text')} AS words FROM benchmark),
c AS (
  SELECT item_id, words,
         CASE WHEN list_position(words || ['[STOP]'], '[STOP]') > 0
              THEN words[1:list_position(words || ['[STOP]'], '[STOP]') - 1] ELSE words END AS cut
  FROM w
),
s AS (
  SELECT item_id, cut,
         list_filter(list_transform(string_split(array_to_string(list_transform(cut,
           lambda x: CASE WHEN x = '.' THEN '.' || chr(1) ELSE x || ' ' END), ''), chr(1)),
           lambda p: regexp_replace(p, '^ +| +$', '', 'g')), lambda p: p <> '') AS dsents
  FROM c
)
SELECT item_id,
       md5(CASE WHEN len(cut) = 0 THEN '' ELSE ' ' || array_to_string(cut, ' ') END) AS regrouped_md5,
       {_len('dsents')} AS n_dec_sents,
       md5(array_to_string(list_transform(dsents, lambda x: replace(replace(x, '<', '&lt;'), '>', '&gt;')), chr(10)))
         AS rouge_file_md5
FROM s
""")
def q_decoded_regroup(spark, sf_dir):
    """P20, P25, P27, K8 body: decoded words cut at [STOP], regrouped into sentences."""
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.word_punct_tokens("text").alias("words"))
    c = b.withColumn("cut", tx.cut_at_stop("words")).withColumn("dsents", tx.decoded_sentences("cut"))
    return c.select("item_id", F.md5(tx.regroup_decoded("cut")).alias("regrouped_md5"),
                    F.size("dsents").cast("long").alias("n_dec_sents"),
                    F.md5(F.array_join(F.transform("dsents", tx.html_safe), "\n")).alias("rouge_file_md5"))


@query("url_parts", """
SELECT page_id,
       string_split(url, '/')[-1] AS doc_key,
       CASE WHEN string_split(split_part(url, '//', 2), '.')[1] = 'www'
            THEN string_split(split_part(url, '//', 2), '.')[2]
            ELSE string_split(split_part(url, '//', 2), '.')[1] END AS site,
       CASE WHEN instr(url, '//') > 0 THEN split_part(split_part(url, '//', 2), '/', 1) END AS host,
       CASE WHEN url IN ('n/a', 'NA') THEN NULL ELSE url END AS url_or_null
FROM pages
""")
def q_url_parts(spark, sf_dir):
    """P1, P2, P3, P4 on every page url."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", uf.doc_id_from_url("url").alias("doc_key"), uf.short_site("url").alias("site"),
                    uf.host("url").alias("host"), uf.na_url("url").alias("url_or_null"))


def _markup_to_text_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for k, v in hf.ENTITIES:
        v_sql = v.replace("'", "''")
        out = f"replace({out}, '{k}', '{v_sql}')"
    return sq.strip_ws(sq.collapse_ws(out))


_DROP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


@query("page_text", f"""
WITH c AS (SELECT page_id, html, regexp_replace(html, '{_DROP}', ' ', 'g') AS clean FROM pages),
s AS (
  SELECT page_id, clean, html,
         string_split(regexp_replace(clean, '(?i)<h[1-6][^>]*>', chr(1), 'g'), chr(1)) AS pieces FROM c
),
t AS (
  SELECT page_id, {_markup_to_text_sql('clean')} AS body,
         {_markup_to_text_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         pieces[2:] AS secs
  FROM s
)
SELECT page_id, md5(body) AS text_md5, CAST(length(body) AS BIGINT) AS text_len, title,
       {_len('secs')} AS n_sections,
       array_to_string(list_transform(secs, lambda p: {_markup_to_text_sql("regexp_extract(p, '(?is)^(.*?)</h[1-6]', 1)")}), ' | ')
         AS section_titles
FROM t
""")
def q_page_text(spark, sf_dir):
    """P28 page flattening, page title and heading sections of every page."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    t = p.select("page_id", hf.html_text("html").alias("body"), hf.page_title("html").alias("title"),
                 hf.html_sections("html").alias("secs"))
    return t.select("page_id", F.md5("body").alias("text_md5"), F.length("body").cast("long").alias("text_len"),
                    "title", F.size("secs").cast("long").alias("n_sections"),
                    F.array_join(F.transform("secs", lambda s: s["title"]), " | ").alias("section_titles"))
