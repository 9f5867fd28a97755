"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsumm.session import ensure_checkpoint_dir

KEY = ("ka", "kb")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    cuts the lineage, survives lost executors, keeps column pruning.  Shuffle files
    go when the driver collects their handles: as the table replaces them, that is
    asked for at once instead of waiting for a full heap."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``stage`` that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Adds a 128-bit row key over ``cols`` (null-safe).  Equal rows share a
    key, which every operator treats as repeats of one row."""
    return df.withColumns({"ka": F.xxhash64(F.lit(1), *cols), "kb": F.xxhash64(F.lit(2), *cols)})


def dense_rank_of(df: DataFrame, keys: list[str], order: list[Column], name: str,
                  buckets: int = 1024) -> DataFrame:
    """0-based rank inside each group of ``keys``, without gathering a group:
    rows fall into ``buckets`` hash buckets of the order columns, bucket counts
    are pre-aggregated, and only a bucket's rows are ranked together."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           F.col("_b").alias("_kb"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    ranked = b.withColumn("_r", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (ranked.join(starts, cond)
            .withColumn(name, (F.col("_r") + F.col("_at")).cast("long"))
            .drop("_b", "_kb", "_r", "_at", *[f"_k{i}" for i in range(len(keys))]))


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with neutral column names, and the name each column got: extra
    columns cannot clash with working names."""
    names = {c: f"_o{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def map_with_results(df: DataFrame, mapper, results: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for a ``mapper`` that appends the columns of ``results`` to
    every batch.  Columns of ``df`` with a name of ``results`` (as the session
    compares names) are replaced; all others may have any name."""
    left = df.drop(*results.names)
    plain = left.toDF(*[f"_o{i}" for i in range(len(left.columns))])
    schema = T.StructType([*plain.schema.fields, *results.fields])

    def named(batches):
        for columns in mapper(batches):
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(named, schema).toDF(*left.columns, *results.names)


def place_of(df: DataFrame, column: str, results: T.StructType) -> int:
    """Position of ``column`` in the batches that the mapper of ``map_with_results`` gets."""
    return df.drop(*results.names).columns.index(column)


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``hidden`` under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
