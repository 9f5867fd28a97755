"""End-to-end training-set path on fixtures: question set ->
collection -> abstract-to-snippet examples (end tag, sentence tags, question
prefix) -> JSON lines, and sentence labels on the same collection."""

import json
import os

from pyspark.sql import functions as F

from qsumm.functions import text as tx
from qsumm.operators import questions as qs
from qsumm.operators import rouge as rg
from qsumm.operators.collection import dense_ids
from qsumm.sources import files as fl
from qsumm.sources import sinks as sk


def test_training_examples_from_question_set(spark, fix, scratch):
    q = fl.read_question_set(spark, fix("questions.json"))
    arts = fl.read_articles(spark, fix("articles.json"))
    coll, _ = qs.build_collection(q, arts)
    ex = dense_ids(coll, ["q_pos", "snip_pos"], "ex_id")
    ex = (ex.withColumn("summary", tx.tag_sentences(tx.sentences(tx.with_end_tag("snippet"))))
            .withColumn("articles", tx.with_question("question", "article")))
    sk.write_json_lines(ex.select("ex_id", "question", "summary", "articles"), os.path.join(scratch, "train"))
    rows = sorted((json.loads(line) for f in os.listdir(os.path.join(scratch, "train")) if f.endswith(".json")
                   for line in open(os.path.join(scratch, "train", f))), key=lambda r: r["ex_id"])
    assert [r["ex_id"] for r in rows] == list(range(len(rows))) and len(rows) == 4
    first = rows[0]
    assert first["question"] == "Is aspirin safe?"
    # the end tag follows a sentence end, so the rule splitter makes it a sentence of its own
    assert first["summary"] == "<s> Redefined snippet. </s> <s> [END] </s>"
    assert first["articles"].startswith("Is aspirin safe? [QUESTION?] Diabetes is a disease.")
    # labels: the snippet sentence appears verbatim in its article -> label 1 there
    lab = rg.sentence_labels(coll.withColumn("sents", tx.sentences("article"))
                                 .withColumn("ref", tx.sentences("snippet")), "sents", "ref")
    got = {r.snippet: r.labels for r in lab.collect()}
    assert got["Redefined snippet."] == [0, 1, 0]
    assert got["The dose is 10 mg."] == [0, 1, 0]
    assert all(len(v) == 3 for v in got.values())
