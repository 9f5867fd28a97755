"""Question-set collection (S1 rows -> DM3): P1, P13, W3, J1, F1, W4.

One row per kept snippet: ``(file, q_pos, question, q_type, ideal_answer,
exact_answer, snip_pos, snippet, pmid, article)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsumm.functions.urls import doc_id_from_url
from qsumm.operators.collection import last_definition, with_article


def exact_answer(q_type, raw) -> F.Column:
    """None for ``summary``; first element for ``yesno``; otherwise the string
    itself or the first element of a list (which may itself be a list).

    ``raw`` is the JSON text of the source value; it is typed with VARIANT.
    For a ``yesno`` answer given as a plain string the whole string is returned
    (the reference would take its first character)."""
    r = F.col(raw) if isinstance(raw, str) else raw
    is_arr = F.startswith(F.ltrim(r), F.lit("["))
    first = F.variant_get(F.try_parse_json(r), "$[0]", "string")
    t = F.col(q_type) if isinstance(q_type, str) else q_type
    return (F.when(t == "summary", F.lit(None).cast("string"))
            .when(is_arr, first)
            .otherwise(r))


def build_collection(questions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (collection, dropped snippets).  Duplicate question bodies: the
    last definition wins, placed at the first position (W3).  Positions count inside a
    file and files follow each other by path, so ``file`` (null if not given) and
    ``q_pos`` together order the questions."""
    if "file" not in questions.columns:
        questions = questions.withColumn("file", F.lit(None).cast("string"))
    q = questions.select(F.struct("file", "q_pos").alias("at"), "body", "type", "ideal_answer", "exact_answer", "snippets")
    q = last_definition(q, "body", "at")
    q = q.select("at.file", "at.q_pos", F.col("body").alias("question"), F.col("type").alias("q_type"),
                 F.try_element_at("ideal_answer", F.lit(1)).alias("ideal_answer"),
                 exact_answer("type", "exact_answer").alias("exact_answer"),
                 F.posexplode(F.coalesce("snippets", F.array())).alias("snip_pos", "s"))
    snips = q.select("file", "q_pos", "question", "q_type", "ideal_answer", "exact_answer", "snip_pos",
                     F.col("s.text").alias("snippet"), doc_id_from_url(F.col("s.document")).alias("pmid"))
    kept, dropped = with_article(snips, articles.select("pmid", "article"), "pmid")
    return kept, dropped
