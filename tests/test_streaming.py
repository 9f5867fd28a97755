"""Streaming jobs equal their batch twins."""

import os

from pyspark.sql import functions as F

from qsumm.operators.metric_log import metric_scan

SF = "/root/testdata/sf0.001"


def test_stream_smoothing_equals_batch(spark, scratch):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    # several files in time order -> several micro-batches
    (ev.withColumn("part", F.ntile(4).over(__import__("pyspark.sql").sql.Window.orderBy("ts", "event_id")))
       .write.partitionBy("part").parquet(os.path.join(scratch, "ev")))
    from qsumm.streaming.metric_stream import run_events_stream
    src = os.path.join(scratch, "ev_flat")
    for p in range(1, 5):
        spark.read.parquet(os.path.join(scratch, "ev", f"part={p}")).write.parquet(os.path.join(src, f"p{p}"))
    import glob
    import shutil
    flat = os.path.join(scratch, "flat")
    os.makedirs(flat)
    for i, f in enumerate(sorted(glob.glob(os.path.join(src, "p*", "*.parquet")))):
        dst = os.path.join(flat, f"events-{i:03d}.parquet")
        shutil.copy(f, dst)
        os.utime(dst, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))  # arrival order = time order
    streamed = run_events_stream(spark, flat, "test").select(
        F.col("series").alias("event_type"), F.col("tie").alias("event_id"),
        F.round("smoothed", 9).alias("s"), "is_best", "runs", "late_dropped")
    batch = metric_scan(ev, "event_type", ["ts", "event_id"], "value", chunk=64).select(
        "event_type", "event_id", F.round("smoothed", 9).alias("s"), "is_best", "runs")
    assert streamed.where("late_dropped > 0").count() == 0
    diff = streamed.drop("late_dropped").exceptAll(batch).count() + batch.exceptAll(streamed.drop("late_dropped")).count()
    assert diff == 0


def test_stream_of_out_of_order_files_equals_batch(spark, scratch):
    import glob
    import shutil

    from qsumm.streaming.metric_stream import run_events_stream
    ev = spark.read.parquet(f"{SF}/events.parquet")
    flat = os.path.join(scratch, "flat")
    os.makedirs(flat)
    for i in range(3):  # every file spans all times; the second and third arrive late as a whole
        part = os.path.join(scratch, f"p{i}")
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(part)
        dst = os.path.join(flat, f"events-{i}.parquet")
        shutil.copy(glob.glob(os.path.join(part, "*.parquet"))[0], dst)
        os.utime(dst, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    streamed = run_events_stream(spark, flat, "disorder").select(
        F.col("series").alias("event_type"), F.col("tie").alias("event_id"),
        F.round("smoothed", 9).alias("s"), "is_best", "runs")
    batch = metric_scan(ev, "event_type", ["ts", "event_id"], "value", chunk=64).select(
        "event_type", "event_id", F.round("smoothed", 9).alias("s"), "is_best", "runs")
    assert streamed.count() == ev.count()
    assert streamed.exceptAll(batch).count() + batch.exceptAll(streamed).count() == 0


def as_files(rows, scratch, parts):
    """``rows`` as one file per value of ``part``, arriving in its order."""
    import glob
    import shutil
    flat = os.path.join(scratch, "flat")
    os.makedirs(flat)
    for i in range(parts):
        part = os.path.join(scratch, f"p{i}")
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(part)
        dst = os.path.join(flat, f"events-{i}.parquet")
        shutil.copy(glob.glob(os.path.join(part, "*.parquet"))[0], dst)
        os.utime(dst, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return flat


def test_one_hot_series_with_nulls_and_repeats_equals_batch(spark, scratch, monkeypatch):
    from qsumm.streaming import metric_stream
    monkeypatch.setattr(metric_stream, "PART_ROWS", 7)  # every slice has many parts
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_type", F.lit("all"))
    ev = ev.withColumn("value", F.when(F.col("event_id") % 11 > 0, F.col("value")))
    ev = ev.unionByName(ev.where("event_id % 50 = 3")).where("event_id % 2 = 1 or event_id < 400")
    flat = as_files(ev.withColumn("part", (F.col("event_id") % 3).cast("int")), scratch, 3)
    out = metric_stream.run_events_stream(spark, flat, "hot", width_ms=6 * 3_600_000)
    streamed = out.select(F.col("series").alias("event_type"), F.col("tie").alias("event_id"), "smoothed", "is_best",
                          "runs", "stop")
    batch = metric_scan(ev, "event_type", ["ts", "event_id"], "value", chunk=64).select(*streamed.columns)
    assert streamed.count() == ev.count()
    assert streamed.exceptAll(batch).count() + batch.exceptAll(streamed).count() == 0  # to the bit
    assert metric_stream.late_rows(ev, out, "event_type", "ts", "event_id").count() == 0


def test_rows_behind_a_given_delay_are_listed(spark, scratch):
    from qsumm.streaming import metric_stream
    ev = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    early, mid = ev.agg(F.percentile(at, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("m")).first()["m"]
    late = at < early
    # The last third of the time comes first.  The engine takes a batch against the
    # watermark of the batch before it, so the middle third is in time, the first is not.
    flat = as_files(ev.withColumn("part", F.when(late, 2).when(at < mid, 1).otherwise(0)), scratch, 3)
    out = metric_stream.run_events_stream(spark, flat, "late", delay=0, width_ms=3_600_000)
    dropped = metric_stream.late_rows(spark.read.parquet(flat), out, "event_type", "ts", "event_id")
    assert {r["event_id"] for r in dropped.select("event_id").collect()} == {
        r["event_id"] for r in ev.where(late).select("event_id").collect()}
    kept = metric_scan(ev.where(~late), "event_type", ["ts", "event_id"], "value", chunk=64)
    cols = [F.col("tie").alias("event_id"), "smoothed", "is_best", "runs"]
    same = kept.select("event_id", "smoothed", "is_best", "runs")
    assert out.select(*cols).exceptAll(same).count() + same.exceptAll(out.select(*cols)).count() == 0


def _predictions(spark, lo, hi):
    rows = [(f"s{i % 2}", " ".join(f"w{(i * k) % 7}" for k in range(1, 6)), "w1 w2 w3 w4 w5") for i in range(lo, hi)]
    rows += [(None, None, "w1 w2"), ("s0", "", "w1")]
    return spark.createDataFrame(rows, "system string, gen string, summary string")


def test_snapshots_survive_replays_lost_commits_and_readers(spark, scratch):
    from qsumm.streaming.scoring_stream import Snapshots, score_batch
    a, b = _predictions(spark, 0, 30), _predictions(spark, 30, 70)
    snaps = Snapshots(spark, f"{scratch}/snaps")
    assert snaps.current() == -1 and snaps.read().count() == 0
    snaps.upsert(a, 0)
    reader = snaps.read()  # opened at version 0
    first = sorted(map(str, reader.collect()))
    snaps.upsert(a, 0)  # replayed after its commit
    assert sorted(map(str, snaps.read().collect())) == first
    snaps.stage(b.limit(3), 1, 0)  # lost before its commit, half the rows
    assert snaps.current() == 0 and sorted(map(str, snaps.read().collect())) == first
    snaps = Snapshots(spark, f"{scratch}/snaps")  # a new driver
    snaps.upsert(b, 1)
    want = sorted(map(str, score_batch(a.union(b)).collect()))
    assert sorted(map(str, snaps.read().collect())) == want
    assert sorted(map(str, reader.collect())) == first  # the old reader still has its version
    assert sorted(map(str, snaps.read(0).collect())) == first


def test_scoring_stream_goes_on_from_its_folder(spark, scratch):
    from qsumm.streaming.scoring_stream import Snapshots, run_prediction_stream, score_batch
    src, base = f"{scratch}/src", f"{scratch}/base"
    _predictions(spark, 0, 20).repartition(2).write.parquet(src)
    run_prediction_stream(spark, src, "t", base=base)
    _predictions(spark, 20, 50).repartition(2).write.mode("append").parquet(src)
    out = run_prediction_stream(spark, src, "t", base=base)
    whole = score_batch(spark.read.parquet(src))
    assert sorted(map(str, Snapshots(spark, base).read().collect())) == sorted(map(str, whole.collect()))
    assert out.count() == 3
