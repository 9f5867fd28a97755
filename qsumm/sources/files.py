"""Readers for the corpus file formats.

Line-delimited inputs split across tasks; inputs that are one JSON object per
file (the reference's format) are read whole per file, which is as far as a
single object can be split, and exploded right away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsumm.functions.text import WS_CLASS

QUESTION_SCHEMA = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("documents", T.ArrayType(T.StringType())),
    T.StructField("ideal_answer", T.ArrayType(T.StringType())),
    # string, list or nested list in the source: kept as raw JSON text, typed later
    T.StructField("exact_answer", T.StringType()),
    T.StructField("snippets", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("document", T.StringType())]))),
])


def read_question_set(spark: SparkSession, path: str) -> DataFrame:
    """``{"questions": [...]}`` files -> one row per question with ``q_pos``
    (position in the file) and ``file`` (source path)."""
    raw = (spark.read.option("multiLine", True)
           .schema(T.StructType([T.StructField("questions", T.ArrayType(QUESTION_SCHEMA))])).json(path)
           .withColumn("file", F.col("_metadata.file_path")))
    return raw.select("file", F.posexplode("questions").alias("q_pos", "q")).select("file", "q_pos", "q.*")


def read_articles(spark: SparkSession, path: str, one_object: bool = True) -> DataFrame:
    """Article store ``(pmid, article)``.  ``one_object``: files holding one
    ``{pmid: text}`` object; otherwise JSON lines with ``pmid`` and ``article``."""
    if not one_object:
        return spark.read.schema("pmid string, article string").json(path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("pmid", "article"))


def read_qa_sheet(spark: SparkSession, path: str) -> DataFrame:
    """S3: question-answer sheet (CSV with header); no missing-value inference:
    empty cells stay empty strings, ``n/a``/``NA`` stay text (P4 handles them)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    return df.withColumn("a_pos", F.monotonically_increasing_id())


def read_xml_pages(spark: SparkSession, path: str, row_tag: str = "document") -> DataFrame:
    """S4 + F10: one crawled XML document per file, any directory depth.

    Root attributes ``url corpus id``; sections ``array<struct<title, children,
    text>>`` where ``children`` are the section's child element texts in order.
    A malformed document gives a row with null fields (PERMISSIVE); its path
    is kept in ``path``.
    """
    schema = T.StructType([
        T.StructField("_url", T.StringType()), T.StructField("_corpus", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("section", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()), T.StructField("text", T.ArrayType(T.StringType()))]))),
        T.StructField("_corrupt_record", T.StringType()),
    ])
    df = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
          .option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt_record")
          .schema(schema).load(path).withColumn("path", F.col("_metadata.file_path")))
    sections = F.transform(F.coalesce("section", F.array()), lambda s: F.struct(
        s["title"].alias("title"),
        F.concat(F.array(s["title"]), F.coalesce(s["text"], F.array().cast("array<string>"))).alias("children"),
        F.try_element_at(s["text"], F.lit(1)).alias("text")))
    return df.select(F.col("_url").alias("url"), F.col("_corpus").alias("corpus"), F.col("_id").alias("id"),
                     sections.alias("sections"),
                     (F.col("_corrupt_record").isNotNull() | F.col("_url").isNull()).alias("malformed"), "path")


EXAMPLE_SCHEMA = "map<string, struct<question:string, summary:string, articles:string>>"
MULTI_SCHEMA = "map<string, struct<question:string, summary:string, articles:map<string, array<string>>>>"
PRIMARY_SCHEMA = "map<string, struct<answers:map<string, struct<url:string, article:string>>>>"


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``{id: {question, summary, articles}}`` -> ``(id, question, summary, article)``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", EXAMPLE_SCHEMA)).alias("id", "e")).select(
        "id", "e.question", "e.summary", F.col("e.articles").alias("article"))


def read_multi_examples(spark: SparkSession, path: str) -> DataFrame:
    """Multi-document examples, one row per answer; element 0 of each answer list."""
    whole = spark.read.text(path, wholetext=True)
    e = whole.select(F.explode(F.from_json("value", MULTI_SCHEMA)).alias("q_id", "e"))
    return e.select("q_id", "e.question", "e.summary", F.explode("e.articles").alias("answer_id", "texts")).select(
        "q_id", "question", "summary", "answer_id", F.try_element_at("texts", F.lit(1)).alias("article"))


def read_primary(spark: SparkSession, path: str) -> DataFrame:
    """``(q_id, a_id, url, article)`` with the source order kept as
    ``(q_pos, a_pos)`` (map order is file order)."""
    whole = spark.read.text(path, wholetext=True)
    e = whole.select(F.posexplode(F.from_json("value", PRIMARY_SCHEMA)).alias("q_pos", "q_id", "q"))
    return e.select("q_pos", "q_id", F.posexplode("q.answers").alias("a_pos", "a_id", "a")).select(
        "q_pos", "q_id", "a_pos", "a_id", "a.url", "a.article")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Columnar prediction files -> one row per example ``(file, ex_id, question_id,
    question, ref, gen)``; zipping stops at the shortest column."""
    schema = ("question array<string>, ref_summary array<string>, gen_summary array<string>, "
              "question_id array<string>")
    raw = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    n = F.least(F.size("question"), F.size("ref_summary"), F.size("gen_summary"))
    z = F.arrays_zip("question", "ref_summary", "gen_summary", "question_id")
    return raw.select("file", n.alias("__n"), F.posexplode(z).alias("ex_id", "z")).where(F.col("ex_id") < F.col("__n")).select(
        "file", "ex_id", F.col("z.question_id").alias("question_id"), F.col("z.question").alias("question"),
        F.col("z.ref_summary").alias("ref"), F.col("z.gen_summary").alias("gen"))


def read_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """S9 input: ``(line_no, value)``; line numbers from the file order."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line_no", "value"))


def read_stories(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Story files -> ``(file_name, source, lines)`` with stripped lines."""
    whole = spark.read.text(path, wholetext=True).withColumn("file_name", F.col("_metadata.file_name"))
    raw = F.split("value", r"\n", -1)
    # a final newline ends the last line; it does not start an empty one
    raw = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    lines = F.transform(raw, lambda l: F.regexp_replace(l, f"^{WS_CLASS}+|{WS_CLASS}+$", ""))
    return whole.select("file_name", F.lit(source).alias("source"), lines.alias("lines"))
