"""Registered queries of the llm subpackage against SQL, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from qsumm.llm import jaccard, queries
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    kept = corpus_pipeline.quality_stage(spark, docs, SF_SMALL).cache()
    verdict = {r["doc_id"] for r in queries.op6_quality_rules(spark, SF_SMALL).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict
    single = corpus_pipeline.near_duplicate_stage(spark, kept, SF_SMALL).cache()
    assert single.count() == jaccard.cluster(kept).select("component_id").distinct().count()
    cut = corpus_pipeline.repeated_text_stage(spark, single, SF_SMALL)
    assert cut.count() == single.count() and cut.dtypes == docs.dtypes
    assert cut.where("n_chars <> length(text)").count() == 0
