"""Section search at any depth, real child order, broken and hostile pages."""

from xml.etree import ElementTree

from qsumm.operators.sections import tree_section
from qsumm.sources import xml_tree as xt

NESTED = """<document url="u" corpus="C" id="7"> intro
 <section><title>Uses</title><text>all <b>kinds</b> of things</text> tail
  <section><title>Dosage</title><text>Take one.</text></section></section>
 <section><text>before</text><title>Order</title></section>
 <section><title>Three</title><text>a</text><note>b</note></section>
 <section><title>Twice</title><text>first</text></section><section><title>Twice</title><text>second</text></section>
 <section><title><i>mark</i>Late &amp; "quoted"</title><deep><deeper><text>down <text>here</text></text></deeper></deep></section>
 <section><title>What to do before taking</title><part><text>Tell
   your doctor</text></part></section></document>"""


def pick(spark, wanted, document=NESTED, answer="a"):
    df = spark.createDataFrame([(wanted, document, answer)], "w string, xml string, a string")
    r = tree_section(xt.with_page_tree(df, "xml"), "w", "a").first()
    return r["section_kind"], r["section_raw"], r["section_text"]


def test_sections_at_any_depth(spark):
    assert pick(spark, "Dosage")[:2] == ("exact", "Take one.")
    assert pick(spark, "Uses")[0] == "rejected"  # title, text and a section
    kind, raw, _ = pick(spark, "Uses", NESTED.replace('"C"', '"DailyMed"'))
    assert kind == "exact" and raw == "all kinds of things tail\n  "  # with the text up to the next tag
    assert pick(spark, "Order")[:2] == ("exact", "Order")  # the second child is the title
    assert pick(spark, "Three")[0] == "rejected" and pick(spark, "Twice")[0] == "rejected"
    assert pick(spark, 'Late & "quoted"')[:2] == ("exact", "down here")  # a later text node of the title counts
    kind, raw, text = pick(spark, "BEFORE taking")
    assert kind == "contains" and raw == "Tell\n   your doctor" and text == "Tell your doctor"
    assert pick(spark, "before taking", answer="x" * 99)[0] == "short"
    assert pick(spark, "Nothing")[0] == "none" and pick(spark, "")[0] == pick(spark, None)[0] == "missing"


def test_walk_equals_a_tree(spark):
    page, root = xt.walk(NESTED), ElementTree.fromstring(NESTED)
    assert page["full_text"] == "".join(root.itertext())
    assert (page["url"], page["corpus"], page["id"]) == ("u", "C", "7")
    up = {c: p for p in root.iter() for c in p}
    titles = list(root.iter("title"))
    assert [t["title"] for t in page["titles"]] == [t.text for t in titles]
    for got, t in zip(page["titles"], titles):
        assert [c["text"] for c in got["children"]] == ["".join(c.itertext()) + (c.tail or "") for c in up[t]]
        first = up[t].find(".//text")
        assert got["first_text"] == (None if first is None else "".join(first.itertext()) + (first.tail or ""))


def test_broken_and_hostile_pages_are_kept(spark):
    bombs = ['<!DOCTYPE d [<!ENTITY a "aaaa">]><document url="u">&a;</document>', "<document><section></document>", "", None,
             "<a>" * 5000 + "</a>" * 5000]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bombs)], "i int, xml string")
    got = xt.with_page_tree(df, "xml").collect()
    assert len(got) == len(bombs) and all(r["malformed"] and r["titles"] is None for r in got)


def test_directory_of_pages(spark, fix):
    pages = xt.read_page_trees(spark, fix("xml"))
    assert pages.count() == 4 and pages.where("malformed").count() == 1
    got = tree_section(pages.withColumn("w", pages["url"].substr(1, 0)), "w", "url").select("section_kind").distinct().collect()
    assert [r[0] for r in got] == ["missing"]


def test_pages_leave_a_task_in_small_batches():
    import pyarrow as pa

    texts = ["x" * 900, None, "y" * 300, "", "z" * 5000, "w" * 10, "v" * 10] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "xml"])
    parts = list(xt._slices(batch, "xml", 2000))
    assert [v for p in parts for v in p.column("xml").to_pylist()] == texts
    assert max(sum(len(v or "") for v in p.column("xml").to_pylist()) for p in parts) <= 2000 + 5000
    assert not list(xt._slices(batch.slice(0, 0), "xml"))
    assert xt.BATCH_BYTES <= 4 << 20
