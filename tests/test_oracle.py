"""Catalogue queries against their DuckDB oracle (the driver's gate, locally).

Default run: every query with an oracle at sf0.001.  ``QSUMM_ORACLE_SF`` picks
another scale folder.
"""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from qsumm.sources.tables import TABLES

SF = os.environ.get("QSUMM_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = entry.queries()[name](spark, SF).toPandas()
    dd = duck.execute(entry.oracle_sql()[name]).df()
    sc, sr = _rows(sp)
    dc, dr = _rows(dd)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_query_has_a_docstring_and_runs_lazily():
    for name, fn in entry.queries().items():
        assert callable(fn)
    assert set(entry.oracle_sql()) <= set(entry.queries())
