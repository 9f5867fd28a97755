"""Scale rules: no cross joins, pushdown and pruning reach the scan, no driver
collection inside the library."""

import os
import re

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ["passage_match", "system_rouge", "encoded_examples", "page_answers", "collection_stats",
                 "metric_smoothing", "decoded_roundtrip"]:
        plan = _plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["url_parts"](spark, SF))
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert m and "html" not in m.group(1)


def test_library_never_collects():
    """No way to the driver but one-row results (``first``, ``count``, ``isEmpty``).
    The corpus operators in ``llm/`` fetch bounded tables; their own test names each."""
    bad = []
    ways = re.compile(r"\.collect\(\)|\.toPandas\(|\.toLocalIterator\(|\.(take|tail|head)\(\d*\)|localCheckpoint|\.rdd\b")
    for dirpath, _, files in os.walk(os.path.join(ROOT, "qsumm")):
        if os.path.basename(dirpath) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                bad += [(f, m.group()) for m in ways.finditer(open(os.path.join(dirpath, f)).read())]
    assert not bad, bad


def test_single_partition_exchanges_only_feed_small_results(spark):
    """SURVEY section 5: no single-partition step over data.  A
    ``SinglePartition`` exchange may only feed a global aggregate (partial
    results, one row out) or the offsets window over one row per partition."""
    skip = {"relevance_model", "stream_metric_smoothing", "stream_rouge"}  # streams; the library learner's own plans
    bad = []
    for name, fn in entry.queries().items():
        if name in skip:
            continue
        lines = _plan(fn(spark, SF)).splitlines()
        for k, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            j = k - 1
            while j > 0 and "Sort [__pid" in lines[j]:  # the offsets window sorts its one row per partition
                j -= 1
            parent = lines[j] if j >= 0 else ""
            ok = ("keys=[]" in parent and "Aggregate" in parent) or \
                 ("Window [" in parent and "windowspecdefinition(__pid" in parent)
            if not ok:
                bad.append((name, parent.strip()[:120]))
    assert not bad, bad
