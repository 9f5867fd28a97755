"""The validation query gives every first answer with a page, whatever the length rule says."""

import __spark_entry__ as entry


def _tables(spark, path):
    page = lambda title, body: f"<html><head><title>{title}</title></head><body><p>{body}</p></body></html>"
    spark.createDataFrame(
        [(1, "http://a.org/1", page("Short", "one two")), (2, "http://a.org/2", page("Fits", "one two three four")),
         (3, "http://a.org/3", page("Alone", "no answer")), (4, "http://a.org/4", page("Fits", "later page"))],
        "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(
        [(1, "word " * 40), (2, "An answer. Two."), (4, "later")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


def test_rejected_and_unanswered_examples_stay_with_their_verdict(spark, scratch):
    path = f"{scratch}/t"
    _tables(spark, path)
    got = {r["question"]: (r["a_pos"], r["kept"]) for r in entry.queries()["validation_examples"](spark, path).collect()}
    assert got == {"Short": (1, False), "Fits": (2, True), "Alone": (3, None)}
    rejects = entry.queries()["validation_rejects"](spark, path).collect()
    assert [r["question"] for r in rejects] == ["Short"]
