"""The metric scan equals a row-by-row fold to the bit: re-seeds inside chunks, nulls, clipping, order."""

import random

import pytest

from qsumm.operators.metric_log import metric_scan


def fold(values, decay, clip, patience):
    """The running mean as the training log keeps it, one row at a time."""
    mean, best, last, out = None, None, None, []
    for i, x in enumerate(values):
        if x is not None:
            mean = x if mean is None or mean == 0 else mean * decay + (1 - decay) * x
            mean = min(mean, clip)
        flag = mean is not None and (best is None or mean < best)
        if flag:
            best, last = mean, i
        runs = None if last is None else i - last
        out.append((mean, flag, runs, None if runs is None else runs > patience))
    return out


def series_that_hit_zero():
    rng = random.Random(11)
    logs = {"cancel": [1.0, -1.0, 3.0, 5.0, -4.0, 2.0, -2.0, 7.0, 0.5],  # decay 0.5: 0 after 1, -1
            "zeros": [0.0, 0.0, 4.0, 0.0, -4.0, 1.0],
            "nulls": [None, None, 2.0, None, -2.0, None, 6.0, None],
            "empty": [None, None, None, None, None],
            "high": [40.0, 30.0, 20.0, 1.0, 90.0, 2.0],
            "one": [3.0]}
    logs["mixed"] = [rng.choice([None, 0.0, 1.0, -1.0, 2.0, -2.0, rng.uniform(-3, 30)]) for _ in range(90)]
    return logs


@pytest.mark.parametrize("decay,chunk,block", [(0.5, 3, 2), (0.99, 4, 3), (0.5, 64, 64)])
def test_scan_equals_row_by_row_fold(spark, decay, chunk, block):
    logs = series_that_hit_zero()
    rows = [(s, i, v) for s, vs in logs.items() for i, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, step long, v double").repartition(4)
    got = metric_scan(df, "s", "step", "v", decay=decay, chunk=chunk, block=block, patience=2).collect()
    have = {(r["s"], r["step"]): (r["smoothed"], r["is_best"], r["runs"], r["stop"]) for r in got}
    want = {(s, i): r for s, vs in logs.items() for i, r in enumerate(fold(vs, decay, 12.0, 2))}
    assert have == want  # equality of doubles, not nearness


def test_reseed_inside_a_chunk_with_a_value_entering(spark):
    """Enters the second chunk with 2, becomes exactly 0 there, takes the next value as it is."""
    values = [2.0, 2.0, -2.0, 8.0, 4.0, 4.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "s string, step long, v double")
    got = [r["smoothed"] for r in metric_scan(df, "s", "step", "v", decay=0.5, chunk=2, block=2).orderBy("step").collect()]
    assert got == [2.0, 2.0, 0.0, 8.0, 6.0, 5.0]
