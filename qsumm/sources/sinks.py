"""Writers (K1-K10).  Every writer is a plain DataFrame write: distributed,
one file per task, overwrite semantics so a re-run after a lost executor
gives the same output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NA = "N/A"


def write_json_lines(df: DataFrame, path: str, na_cols=()) -> None:
    """K1: keyed collections as JSON lines (one example per row); NULL rendered
    as the ``N/A`` string in ``na_cols``."""
    for c in na_cols:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(NA)))
    df.write.mode("overwrite").json(path)


def write_parallel_lines(df: DataFrame, path: str, source: str = "source", target: str = "target",
                         order=("shuffle_key", "id")) -> None:
    """K2 + F12: ``.source``/``.target`` line files in the same order.  One table
    holding both columns is range-partitioned by the order key, checkpointed,
    and written once per side from that checkpoint, so line ``i`` of every part
    file of the source side matches line ``i`` of the same part of the target side."""
    from qsumm.operators.stories import line_safe
    bad = line_safe(df, [source, target]).limit(1).count()
    if bad:
        raise ValueError("a source or target text holds a newline; it would break line alignment")
    from qsumm.session import cut_lineage
    # a reliable checkpoint, not a cache: a recomputed range sort after a lost
    # executor could place rows differently and misalign the two files
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    ordered.select(F.col(source).alias("value")).write.mode("overwrite").text(f"{path}.source")
    ordered.select(F.col(target).alias("value")).write.mode("overwrite").text(f"{path}.target")


def write_vocab(vocab_counts: DataFrame, path: str) -> None:
    """K3: ``word count`` lines, most frequent first (one ordered part per range)."""
    lines = vocab_counts.orderBy(F.desc("count"), F.asc("word")).select(
        F.concat_ws(" ", "word", F.col("count").cast("string")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_predictions(preds: DataFrame, path: str, keys=("system", "task", "summ_type")) -> None:
    """K4: row-form predictions partitioned by system/task/summary type."""
    keys = [k for k in keys if k in preds.columns]
    preds.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_sheet(df: DataFrame, path: str, cols=("ref", "gen", "score")) -> None:
    """K5: per-example score sheet as CSV with header."""
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """K6/K7: small result tables (one row per experiment / metric) as CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stats_long(df: DataFrame, keys, metrics) -> DataFrame:
    """K7: wide statistics -> long ``(keys..., metric, value)``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def rouge_files(df: DataFrame, ex_index: str, sents: str, kind: str) -> DataFrame:
    """K8: ``(file_name, text)`` for per-example reference/decoded files: name
    ``%06d_{kind}.txt``, one sentence per line, html-escaped."""
    from qsumm.functions.text import html_safe
    return df.select(F.format_string(f"%06d_{kind}.txt", F.col(ex_index)).alias("file_name"),
                     F.array_join(F.transform(sents, html_safe), "\n").alias("text"))


def write_rouge_files(files: DataFrame, path: str, buckets: int = 64) -> None:
    """K8 writer: the per-example files become rows of text part files partitioned
    by a bucket of the name (no one-file-per-example explosion)."""
    out = files.withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(buckets)))
    out.write.mode("overwrite").partitionBy("bucket").json(path)


def write_chunked(df: DataFrame, path: str, rows_per_file: int = 1000, fmt: str = "json") -> None:
    """K9: output split into files of at most ``rows_per_file`` examples."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def write_vocab_metadata(vocab: DataFrame, path: str) -> None:
    """Id-ordered word list, TSV with header ``word``."""
    vocab.orderBy("word_id").select("word").coalesce(1).write.mode("overwrite") \
        .option("header", True).option("sep", "\t").csv(path)
