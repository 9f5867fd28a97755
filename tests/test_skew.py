"""Hot keys: one series / one key holding most rows still gives exact results
through the chunked and range-partitioned paths (brute force on small data)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from qsumm.operators.collection import dense_ids, rank_within
from qsumm.operators.metric_log import metric_scan, running_mean_seq

SF = "/root/testdata/sf0.001"


def test_metric_scan_hot_series(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = ev.withColumn("event_type", F.when(F.col("event_id") % 10 != 0, F.lit("hot")).otherwise(F.col("event_type")))
    out = metric_scan(hot, "event_type", ["ts", "event_id"], "value", chunk=32, block=4).collect()
    rows = sorted(hot.select("event_type", "ts", "event_id", "value").collect(),
                  key=lambda r: (r.event_type, r.ts, r.event_id))
    want = {}
    for series in {r.event_type for r in rows}:
        vals = [r for r in rows if r.event_type == series]
        for r, m in zip(vals, running_mean_seq([r.value for r in vals])):
            want[r.event_id] = m
    got = {r.event_id: r.smoothed for r in out}
    assert len(got) == len(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    # best-so-far and runs against a sequential pass
    flags = {}
    for series in {r.event_type for r in rows}:
        best, runs = None, 0
        for r in [x for x in rows if x.event_type == series]:
            m = want[r.event_id]
            if best is None or m < best:
                best, runs = m, 0
                flags[r.event_id] = (True, 0)
            else:
                runs += 1
                flags[r.event_id] = (False, runs)
    assert {r.event_id: (r.is_best, r.runs) for r in out} == flags


def test_rank_within_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 7 == 0, F.col("id") % 5).otherwise(F.lit(99)).alias("k"),
                                  F.col("id").alias("pos"))
    got = rank_within(df, "k", "pos", "rk")
    w = Window.partitionBy("k").orderBy("pos")
    want = df.withColumn("rk", (F.row_number().over(w) - 1).cast("long"))
    assert got.select("k", "pos", "rk").exceptAll(want).count() == 0
    assert got.count() == 3000


def test_dense_ids_consecutive(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("x"))
    ids = dense_ids(df, ["x"], "i").orderBy("x").collect()
    assert [r.i for r in ids] == list(range(2000))
