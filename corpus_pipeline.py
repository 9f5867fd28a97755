"""Corpus preparation pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept and
returns a DataFrame; ``run`` writes every stage's result as Parquet in the
shared checkpoint folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsumm.llm import jaccard, mixing, packing, quality, run_index
from qsumm.session import ensure_checkpoint_dir, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# A passage of more than 50 words has 51 letters and 50 blanks at the least and
# about 300 bytes as a rule; a string of 200 bytes lies inside nearly all of them.
REPEAT_BYTES, REPEAT_GRAM = 200, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.kept_documents(docs.select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays."""
    return jaccard.representatives(docs.select(*COLUMNS))


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of ``REPEAT_BYTES`` go from the texts (what is left
    of a character that was cut in two goes too); ``n_chars`` follows the text."""
    cut = run_index.dedup(docs.select(*COLUMNS), with_text=True, window=REPEAT_BYTES, gram=REPEAT_GRAM)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times)."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the packed sequences."""
    return packing.pack_documents(docs.select("doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_text_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# Learned references, Newton iterations and a tokenizer are beyond SQL; the
# pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
