"""Comparison grid: cells, totals, missing scores and null dimensions."""

from pyspark.sql import functions as F

from qsumm.operators.grid import comparison_grid

SCHEMA = "task string, system string, r double, bleu_1_num long, bleu_1_den long, bleu_c long, bleu_r long"


def grid_of(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    out = comparison_grid(d, ["task", "system"], [["task", "system"], ["system"], []], {"score": "r"}, max_n=1)
    return {(r["task"], r["system"], r["n"], r["score"], r["bleu"]) for r in out.collect()}


def test_cells_and_totals(spark):
    got = grid_of(spark, [("a", "x", 1.0, 1, 2, 4, 4), ("a", "x", None, 2, 2, 4, 4), ("b", "x", 0.0, 0, 4, 4, 4),
                          ("a", "y", None, 1, 1, 4, 4), (None, "y", 0.5, 1, 1, 4, 4)])
    assert got == {("a", "x", 2, 1.0, 0.75), ("b", "x", 1, 0.0, 0.0), ("a", "y", 1, None, 1.0), (None, "y", 1, 0.5, 1.0),
                   ("all", "x", 3, 0.5, 0.375), ("all", "y", 2, 0.5, 1.0), ("all", "all", 5, 0.5, 0.5)}


def test_examples_are_not_expanded_per_grouping_set(spark):
    """Expand works on cells: it stands above the aggregate of the examples."""
    d = spark.range(100).select(F.lit("a").alias("task"), F.lit("x").alias("system"), F.lit(1.0).alias("r"))
    plan = comparison_grid(d, ["task", "system"], [["task"], []], {"s": "r"}, bleu=None)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Expand") < text.rindex("Aggregate")


def test_empty_input_has_no_cells(spark):
    assert grid_of(spark, []) == set()
