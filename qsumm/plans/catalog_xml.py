"""Catalogue: crawled XML pages written from the page table, read back and searched
for sections at any depth (S4, F2-F4, F10, P29, P30).

Every page becomes one document, one per line; its shape follows the length of
its title: flat, text before title, three children, nested two levels down,
title inside a longer one, or a missing end tag.  The answer is the document
with ``doc_id = page_id``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qsumm.functions import html as hf
from qsumm.operators.sections import tree_section
from qsumm.plans import sqltext as sq
from qsumm.plans.catalog import query
from qsumm.plans.catalog_text import _markup_to_text_sql
from qsumm.session import ensure_checkpoint_dir
from qsumm.sources.tables import table
from qsumm.sources.xml_tree import with_page_tree

_PAGE_TEXT_SQL = _markup_to_text_sql(
    "regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')")


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_documents(spark, sf_dir):
    """``(a_pos, title, answer, xml)``, one document per page."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("a_pos"), hf.page_title("html").alias("title"),
                                                 hf.html_text("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a_pos"), F.col("text").alias("answer"))
    t, x = _escaped("title"), _escaped("body")
    pair = F.concat(F.lit("<title>"), t, F.lit("</title><text>"), x, F.lit("</text>"))
    shape = F.length("title") % 6
    inner = (F.when(shape == 1, F.concat(F.lit("<section><text>"), x, F.lit("</text><title>"), t, F.lit("</title></section>")))
             .when(shape == 2, F.concat(F.lit("<section>"), pair, F.lit("<note>n</note></section>")))
             .when(shape == 3, F.concat(F.lit("<section><title>Top</title><part><section>"), pair, F.lit("</section></part></section>")))
             .when(shape == 4, F.concat(F.lit("<section><title>About "), t, F.lit("</title><part><text>"), x,
                                        F.lit("</text></part></section>")))
             .when(shape == 5, F.concat(F.lit("<section>"), pair))
             .otherwise(F.concat(F.lit("<section>"), pair, F.lit("</section>"))))
    corpus = F.when(F.length("body") % 2 == 0, "DailyMed").otherwise("Other")
    xml = F.concat(F.lit('<document url="u'), F.col("a_pos").cast("string"), F.lit('" corpus="'), corpus, F.lit('" id="'),
                   F.col("a_pos").cast("string"), F.lit('">'), inner, F.lit("</document>"))
    return pages.join(docs, "a_pos", "left").select("a_pos", "title", "answer", xml.alias("xml"))


@query("xml_sections", f"""
WITH p AS (
  SELECT page_id AS a_pos, {_markup_to_text_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         {_PAGE_TEXT_SQL} AS body FROM pages
),
s AS (
  SELECT p.*, d.text AS answer, length(title) % 6 AS shape, length(body) % 2 = 0 AS exempt
  FROM p LEFT JOIN documents d ON d.doc_id = p.a_pos
),
r AS (
  SELECT *, CASE WHEN title = '' OR shape = 5 THEN NULL WHEN shape = 1 THEN title WHEN shape = 2 AND NOT exempt THEN NULL
                 ELSE body END AS raw FROM s
),
k AS (SELECT *, coalesce(length(raw) >= length(answer), false) AS fits FROM r)
SELECT CAST(a_pos AS BIGINT) AS a_pos, shape = 5 AS malformed,
       CASE WHEN title = '' THEN 'missing' WHEN shape = 2 AND NOT exempt THEN 'rejected' WHEN raw IS NULL THEN 'none'
            WHEN NOT fits THEN 'short' WHEN shape = 4 THEN 'contains' ELSE 'exact' END AS section_kind,
       CAST(length(raw) AS BIGINT) AS raw_len,
       CASE WHEN fits THEN md5({sq.collapse_ws('raw')}) END AS section_md5
FROM k
""")
def q_xml_sections(spark, sf_dir):
    """S4 + F10 round trip, P29 second child in document order, P30 containment,
    F3 two-children rule and its exemption, F2 length rule, F4 missing titles."""
    made = page_documents(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/xml-pages-{uuid.uuid4().hex}"
    made.select(F.concat_ws("\t", F.col("a_pos").cast("string"), F.translate("xml", "\r\n\t", "   ")).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("a_pos"),
                                         F.split_part("value", F.lit("\t"), F.lit(2)).alias("xml"))
    trees = with_page_tree(lines, "xml").join(made.select(F.col("a_pos").cast("long").alias("a_pos"), "title", "answer"), "a_pos")
    out = tree_section(trees, "title", "answer")
    return out.select("a_pos", "malformed", "section_kind", F.length("section_raw").cast("long").alias("raw_len"),
                      F.md5("section_text").alias("section_md5"))
