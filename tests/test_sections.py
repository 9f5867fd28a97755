"""Section lookup and validation rules: exact, contained, absent and missing titles, repeated urls."""

from pyspark.sql import functions as F

from qsumm.functions import html as hf
from qsumm.operators import collection as co
from qsumm.operators.sections import pick_section
from qsumm.plans.catalog_stats import page_answer_matches
from tests.conftest import SF_ORACLE

PAGE = "<h1>Dosage &amp; use</h1><p>Take <b>two</b>\n daily.</p><h2>Side effects</h2>none <i>known</i><h2>side EFFECTS at night</h2>x"


def test_pick_section_kinds(spark):
    wanted = [("Side effects", "exact", "Side effects"), ("SIDE EFF", "contains", "Side effects"),
              ("Dosage & use", "exact", "Dosage & use"), ("O'Brien's \"title\"", "none", None), ("", "missing", None), (None, "missing", None)]
    df = spark.createDataFrame([(i, PAGE, w) for i, (w, _, _) in enumerate(wanted)], "i int, html string, w string")
    got = pick_section(df.withColumn("s", hf.html_sections_raw("html")), "s", "w").orderBy("i").collect()
    assert [(r["match_kind"], r["hit"]["title"] if r["hit"] else None) for r in got] == [(k, t) for _, k, t in wanted]


def test_raw_text_keeps_white_space_and_drops_tags(spark):
    got = spark.createDataFrame([("Take <b>two</b>\n  dai<i>ly</i> &amp; rest",)], "m string").select(hf.raw_text("m")).first()[0]
    assert got == "Take two\n  daily & rest"


def test_last_page_of_a_url_and_unmatched_answers(spark):
    pages = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("v", 3, "c")], "url string, page_id int, html string")
    answers = spark.createDataFrame([(1, "u"), (2, "u"), (3, "w"), (4, None)], "a_pos int, url string")
    used = co.dedup_pages(co.pages_for_urls(pages, answers.select("url").distinct()), "url", "page_id")
    got = {r["a_pos"]: r["page_id"] for r in co.answers_with_pages(answers, used).collect()}
    assert got == {1: 2, 2: 2, 3: None, 4: None}


def test_every_kind_occurs_on_the_tables(spark):
    kinds = {r["match_kind"] for r in page_answer_matches(spark, SF_ORACLE).select("match_kind").distinct().collect()}
    assert kinds == {"exact", "contains", "none", "missing"}


def test_summary_length_rule(spark):
    df = spark.createDataFrame([("a" * 12, "bb"), ("a" * 13, "bb")], "s string, a string")
    assert [r[0] for r in df.select(co.summary_fits("s", "a")).collect()] == [True, False]
    assert df.where(~co.summary_fits("s", "a")).select(F.length("s")).first()[0] == 13
