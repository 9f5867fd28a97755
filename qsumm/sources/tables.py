"""Driver tables (parquet, one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Text-heavy tables and a key to hash-spread them on.
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
# Session setting (off by default): hash-spread text scans over the cores, for
# files that hold one row group and so give one split.  It holds at every size.
SPREAD_CONF = "spark.qsumm.spreadScans"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in SPREAD_KEYS and spark.conf.get(SPREAD_CONF, "false") == "true":
        df = df.repartition(SPREAD_KEYS[name])
    return df
