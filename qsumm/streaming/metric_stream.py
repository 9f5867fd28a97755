"""Streaming running mean / best-so-far / patience over a metric stream.

A stateful processor (``transformWithStateInPandas``) per series.  Rows wait in
map state, under the time slice they belong to and in parts of at most
``PART_ROWS`` rows, until the watermark passes the end of their slice; its timer
then folds the slice in step order and removes it.  Beside the waiting slices a
series keeps five numbers.  A micro-batch writes the parts it adds and reads the
slices it folds, never all that waits; a task holds one slice of one series at
a time, so ``width`` bounds its memory.

Rows behind the watermark of the batch before theirs are dropped by the engine,
before the fold; ``late_rows`` lists them.  A null or NaN value is no step: it keeps the running
mean and counts as a non-improvement.  Rows without a series are a series of
their own, rows without a tie breaker come first at their time, rows without a
time are left out; repeated rows are folded as often as they come.
Event time is cast to ``TIMESTAMP`` before the watermark (``TIMESTAMP_NTZ``
cannot carry one).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from qsumm.operators.metric_log import CLIP, DECAY, running_mean_seq
from qsumm.session import ensure_checkpoint_dir

WIDTH_MS = 86_400_000  # a slice: rows of one series and day are folded together
PART_ROWS = 10_000
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT_SCHEMA = ("series string, ts timestamp, tie long, value double, smoothed double, is_best boolean, "
              "runs long, stop boolean, late_dropped long")


class SeriesFold(StatefulProcessor):
    """Folds one series slice by slice (see the module)."""

    def __init__(self, decay: float, clip: float, patience: int, width: int):
        self.decay, self.clip, self.patience, self.width = decay, clip, patience, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "m double, best double, runs long, folded long, late long")
        self.parts = handle.getMapState("parts", "slice long", "n long")
        self.waiting = handle.getMapState("waiting", "slice long, part long",
                                          "us array<long>, tie array<long>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, best, runs, folded, late = self.run.get() if self.run.exists() else (None, None, None, None, 0)
        seen = late
        for pdf in rows:
            pdf = pdf[~pdf["mark"].astype(bool)]
            at = pdf["us"] // (self.width * 1000)
            for piece, own in pdf.groupby(at):
                piece = int(piece)
                if folded is not None and piece <= folded:
                    late += len(own)  # the engine drops such rows before; never fold out of order
                    continue
                n = self.parts.getValue((piece,))[0] if self.parts.containsKey((piece,)) else 0
                if n == 0:
                    self.handle.registerTimer((piece + 1) * self.width)
                for lo in range(0, len(own), PART_ROWS):
                    cut = own.iloc[lo:lo + PART_ROWS]
                    self.waiting.updateValue((piece, n), (
                        cut["us"].tolist(), [None if pd.isna(t) else int(t) for t in cut["tie"]],
                        [None if pd.isna(v) else float(v) for v in cut["value"]]))
                    n += 1
                self.parts.updateValue((piece,), (n,))
        if late != seen:
            self.run.update((m, best, runs, folded, late))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Slices end in time order, whichever timer comes first.
        now = timerValues.getCurrentWatermarkInMs()
        done = sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.width <= now)
        for piece in done:
            yield self.fold(key[0], piece)

    def fold(self, series, piece: int) -> pd.DataFrame:
        """Folds a complete slice and removes it from the state."""
        us, tie, value = [], [], []
        for part in range(self.parts.getValue((piece,))[0]):
            a, b, c = self.waiting.getValue((piece, part))
            us += a
            tie += b
            value += c
            self.waiting.removeKey((piece, part))
        self.parts.removeKey((piece,))
        order = sorted(range(len(us)), key=lambda i: (us[i], tie[i] is not None, tie[i] or 0))
        m, best, runs, _, late = self.run.get() if self.run.exists() else (None, None, None, None, 0)
        means = running_mean_seq([value[i] for i in order], self.decay, self.clip, m)
        rows = []
        for i, mean in zip(order, means):
            better = mean is not None and (best is None or mean < best)
            if better:
                best, runs = mean, 0
            elif runs is not None:
                runs += 1
            stop = False if self.patience <= 0 else None if runs is None else runs > self.patience
            rows.append((series, us[i], tie[i], value[i], mean, better, runs, stop, late))
        self.run.update((means[-1], best, runs, piece, late))
        out = pd.DataFrame(rows, columns=["series", "ts", "tie", "value", "smoothed", "is_best", "runs", "stop", "late_dropped"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out.astype({"tie": "Int64", "runs": "Int64", "stop": "boolean"})

    def close(self) -> None:
        pass


def smooth_stream(stream: DataFrame, series: str, ts: str, tie: str, value: str, decay: float = DECAY,
                  clip: float = CLIP, patience: int = 5, watermark: str = "0 seconds", mark: str | None = None,
                  width_ms: int = WIDTH_MS) -> DataFrame:
    """Every row with its running mean, best flag and patience counter, in step order
    per series; a row is out once the watermark passes the end of its time slice of
    ``width_ms``.  Rows with a true ``mark`` move the watermark only.  The query must
    run with the state store of ``state_store``."""
    at = F.col(ts).cast("timestamp")
    src = (stream.where(at.isNotNull()).select(F.col(series).alias("series"), at.alias("ts"), F.unix_micros(at).alias("us"),
                         F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"),
                         (F.col(mark) if mark else F.lit(False)).alias("mark"))
           .withWatermark("ts", watermark))
    return src.groupBy("series").transformWithStateInPandas(
        SeriesFold(decay, clip, patience, width_ms), OUT_SCHEMA, "append", "EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that map state and timers need, for queries started inside."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def late_rows(files: DataFrame, out: DataFrame, series: str, ts: str, tie: str) -> DataFrame:
    """The rows of ``files`` that the stream left out of ``out``: dropped behind the
    watermark, or without a time.  Null keys compare as equal."""
    o = out.select(F.col("series").alias("__s"), F.col("ts").alias("__t"), F.col("tie").alias("__i"))
    return files.join(o, F.col(series).eqNullSafe(F.col("__s")) & F.col(ts).cast("timestamp").eqNullSafe(F.col("__t"))
                      & F.col(tie).eqNullSafe(F.col("__i")), "left_anti")


def disorder(files: DataFrame, ts: str) -> tuple[int, int]:
    """(delay, last): milliseconds by which a file's first row can lie behind the
    last row of files that arrive before it (0: files are in time order), and the
    largest time in milliseconds.  Files of equal modification time come in any order."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    each = (files.select(t.alias("t"), F.col("_metadata.file_path").alias("f"),
                         F.unix_millis("_metadata.file_modification_time").alias("at"))
            .groupBy("f", "at").agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    times = each.groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.max("hi").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    prior = F.greatest(before, F.when(F.col("n") > 1, F.col("hi")))
    got = times.select((prior - F.col("lo")).alias("d"), "hi").agg(F.max("d").alias("d"), F.max("hi").alias("hi")).first()
    late = got["d"]
    return (0 if late is None or late < 0 else late // 1000 + 2), (got["hi"] or 0) // 1000


def run_events_stream(spark: SparkSession, src_dir: str, name: str, files_per_trigger: int = 1,
                      glob: str = "events*.parquet", delay: int | None = None, width_ms: int = WIDTH_MS) -> DataFrame:
    """Drive the events stream from parquet files in ``src_dir`` to completion
    (``availableNow``) into a parquet table under the shared checkpoint folder;
    return that table.  The watermark delay in milliseconds is ``delay`` (a stream
    whose files are still to come) or the disorder of the files that are there; a
    closing mark behind the last slice then releases the rows that still wait."""
    files = spark.read.option("pathGlobFilter", glob).parquet(src_dir)
    schema = files.schema
    needed, last = disorder(files, "ts")
    delay = needed if delay is None else delay
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    closing = (spark.range(1).select(F.timestamp_millis(F.lit(last + delay + width_ms + 1000)).alias("at")))
    closed = T.StructType([*schema.fields, T.StructField("__mark", T.BooleanType())])
    marks = closing.select(*[(F.col("at") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schema.fields], F.lit(True).alias("__mark"))
    marks.limit(0).write.parquet(f"{base}/marks")

    def drain() -> DataFrame:
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                  .option("pathGlobFilter", glob).parquet(src_dir).withColumn("__mark", F.lit(False)))
        end = spark.readStream.schema(closed).parquet(f"{base}/marks")
        out = smooth_stream(stream.unionByName(end), "event_type", "ts", "event_id", "value",
                            watermark=f"{delay} milliseconds", mark="__mark", width_ms=width_ms)
        q = (out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        return out

    with state_store(spark):
        drain()
        marks.write.mode("append").parquet(f"{base}/marks")
        out = drain()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
