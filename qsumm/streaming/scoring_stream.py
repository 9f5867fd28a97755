"""Continuous ROUGE scoring of newly arriving predictions.

Scoring is stateless per row.  Every micro-batch adds its own sums per system (its
increment) to the last committed version and writes the result as a version folder of
its own; a row in the ``commits`` table then makes it the current one.  A committed
version is never written again, so a reader keeps what it opened while batches go on.

A batch that is run again after a failure either finds its number committed and does
nothing, or overwrites folders that no commit names yet.  Sums are decimals, so they do
not depend on how rows were dealt over batches.  Versions and commits hold one row per
system and one row; old ones stay until the folder is retired with the stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qsumm.operators.rouge import with_rouge
from qsumm.session import ensure_checkpoint_dir

METRICS = ("1", "2", "l")
NO_VERSION = -1


def score_batch(rows: DataFrame, hyp: str = "gen", ref: str = "summary", key: str = "system") -> DataFrame:
    """Number of rows and sums of the ROUGE recalls per ``key``; a null score adds nothing."""
    scored = with_rouge(rows, hyp, ref, max_n=2, alpha=1.0)
    return scored.groupBy(F.col(key).cast("string").alias("system")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"rouge_{m}_r").cast("decimal(20,18)")).cast("decimal(38,18)").alias(f"sum_rouge_{m}")
          for m in METRICS])


class Snapshots:
    """Versions of the sums per system in one shared folder."""

    SCHEMA = "system string, n long, " + ", ".join(f"sum_rouge_{m} decimal(38,18)" for m in METRICS)

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        empty = spark.createDataFrame([], self.SCHEMA)
        empty.write.mode("ignore").parquet(self._version(NO_VERSION))
        empty.select(F.col("n").alias("version")).write.mode("ignore").parquet(f"{self.base}/commits")

    def _version(self, version: int) -> str:
        return f"{self.base}/versions/{version}"

    def current(self) -> int:
        """Number of the last committed batch (``NO_VERSION`` before the first)."""
        commits = self.spark.read.schema("version long").parquet(f"{self.base}/commits")
        top = commits.agg(F.max("version").alias("v")).first()["v"]
        return NO_VERSION if top is None else top

    def read(self, version: int | None = None) -> DataFrame:
        """Sums as of ``version`` (the current one)."""
        at = self.current() if version is None else version
        return self.spark.read.schema(self.SCHEMA).parquet(self._version(at))

    def means(self, version: int | None = None) -> DataFrame:
        return self.read(version).select("system", "n", *[
            F.round(F.col(f"sum_rouge_{m}").cast("double") / F.col("n"), 6).alias(f"rouge_{m}") for m in METRICS])

    def stage(self, batch: DataFrame, batch_id: int, at: int) -> None:
        """Write the increment of a batch and the version that holds it; nobody reads them yet."""
        increment = f"{self.base}/increments/{batch_id}"
        score_batch(batch).write.mode("overwrite").parquet(increment)
        both = self.read(at).unionByName(self.spark.read.schema(self.SCHEMA).parquet(increment))
        both.groupBy("system").agg(
            F.sum("n").alias("n"),
            *[F.sum(f"sum_rouge_{m}").cast("decimal(38,18)").alias(f"sum_rouge_{m}") for m in METRICS],
        ).write.mode("overwrite").parquet(self._version(batch_id))

    def commit(self, batch_id: int) -> None:
        one = self.spark.range(batch_id, batch_id + 1, numPartitions=1)
        one.select(F.col("id").alias("version")).write.mode("append").parquet(f"{self.base}/commits")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink."""
        at = self.current()
        if batch_id > at:
            self.stage(batch, batch_id, at)
            self.commit(batch_id)


def run_prediction_stream(spark: SparkSession, src_dir: str, name: str, files_per_trigger: int = 1,
                          base: str | None = None) -> DataFrame:
    """Score all files there are, then return the current means.  With the same ``base``
    a later call goes on where this one stopped."""
    schema = spark.read.parquet(src_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src_dir)
    base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    snaps = Snapshots(spark, base)
    q = (stream.writeStream.foreachBatch(snaps.upsert)
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return snaps.means()
