"""Model hooks (M1-M4, T10): relevance scoring with a pluggable model, a
trainable relevance model on the A17 labels, batched summary generation, and
a metric registry.

Neural training and beam search are not table work (see README); the hooks
run any picklable Python model inside Arrow batches (``mapInPandas``), the
model being built once per Python worker.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qsumm.functions.text import rouge_tokens, with_question
from qsumm.operators.select import lead_k

_MODELS: dict = {}


def _cached(factory: Callable):
    """The worker's model of a factory.  A function that workers import by name is one
    object for the life of a worker and its model is kept; any other factory (a lambda, a
    closure, a callable object) arrives anew with every task and its model is built there."""
    name = getattr(factory, "__qualname__", None)
    module = sys.modules.get(getattr(factory, "__module__", None) or "")
    if name is None or getattr(module, name, None) is not factory:
        return factory()
    if factory not in _MODELS:
        _MODELS[factory] = factory()
    return _MODELS[factory]


def overlap_scorer():
    """Default relevance model: share of the sentence's ROUGE tokens found in the
    question (a stand-in with the same input and output as a trained model)."""
    import re

    tok = re.compile(r"[a-z0-9]+")

    def score(questions: pd.Series, sentences: pd.Series) -> pd.Series:
        out = []
        for q, sents in zip(questions, sentences):
            qs = set(tok.findall((q or "").lower()))
            row = []
            for s in sents if sents is not None else []:
                t = tok.findall((s or "").lower())
                row.append(sum(1 for x in t if x in qs) / len(t) if t else 0.0)
            out.append(row)
        return pd.Series(out)

    return score


def score_sentences(df: DataFrame, question: str, sents: str, factory: Callable = overlap_scorer,
                    out: str = "probs") -> DataFrame:
    """M1: probability per sentence of every document, in Arrow batches."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _cached(factory)
        for pdf in batches:
            pdf[out] = model(pdf[question], pdf[sents])
            yield pdf

    return df.mapInPandas(run, schema)


def lead_generator():
    """Default generator for M3: the first three sentences."""
    import re

    # same rule as the JVM splitter (qsumm.functions.text.sentences)
    boundary = re.compile(r"([.!?])[ \t\n\r\f\x0b]+|[\n\r]+")

    def gen(articles: pd.Series) -> pd.Series:
        out = []
        for a in articles:
            marked = boundary.sub(lambda m: (m.group(1) or "") + "\x01", a or "")
            sents = [s.strip(" \t\n\r\f\x0b") for s in marked.split("\x01")]
            sents = [s for s in sents if s]
            out.append(" ".join(sents[:3]))
        return pd.Series(out)

    return gen


def generate(df: DataFrame, article: str, question: str | None = None, factory: Callable = lead_generator,
             question_driven: bool = False, out: str = "gen") -> DataFrame:
    """Batch generation with a pluggable generator; batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` (the last batch holds the
    remainder); the alignment check is that every input row yields one output."""
    src = with_question(question, article) if (question_driven and question) else F.col(article)
    staged = df.withColumn("__src", src)
    schema = T.StructType(staged.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _cached(factory)
        for pdf in batches:
            res = model(pdf["__src"])
            if len(res) != len(pdf):
                raise ValueError("generator returned a different number of summaries than inputs")
            pdf[out] = res.values
            yield pdf

    return staged.mapInPandas(run, schema).drop("__src")


def lead_generate_jvm(df: DataFrame, sents: str, k: int = 3, out: str = "gen") -> DataFrame:
    """The JVM twin of the default generator (for checks)."""
    return df.withColumn(out, lead_k(sents, k))


def sentence_rows(labelled: DataFrame, key: str, question: str, sents: str, labels: str) -> DataFrame:
    """Long form ``(key, question, pos, sentence, label)`` of labelled examples."""
    z = F.arrays_zip(F.col(sents).alias("s"), F.col(labels).alias("l"))
    return labelled.select(key, question, F.posexplode(z).alias("pos", "z")).select(
        key, question, "pos", F.col("z.s").alias("sentence"), F.col("z.l").cast("double").alias("label"))


def relevance_features(rows: DataFrame, question: str = "question", sentence: str = "sentence") -> DataFrame:
    st, qt = rouge_tokens(sentence), rouge_tokens(question)
    overlap = F.size(F.filter(st, lambda t: F.array_contains(qt, t)))
    return (rows.withColumn("tokens", st)
            .withColumn("overlap", F.when(F.size(st) > 0, overlap / F.size(st)).otherwise(F.lit(0.0)))
            .withColumn("position", F.col("pos").cast("double"))
            .withColumn("length", F.size(st).cast("double")))


def train_relevance(train: DataFrame, num_features: int = 1 << 18, max_iter: int = 50):
    """M2: HashingTF + IDF + overlap/position/length features, logistic regression."""
    pipe = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="tfidf"),
        VectorAssembler(inputCols=["tfidf", "overlap", "position", "length"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01),
    ])
    return pipe.fit(train)


def evaluate_relevance(model, valid: DataFrame) -> float:
    pred = model.transform(valid)
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(pred)


def class1_probability(col: str = "probability") -> Column:
    """Probability of class 1 from a probability vector (JVM side)."""
    from pyspark.ml.functions import vector_to_array
    return F.element_at(vector_to_array(F.col(col)), 2)


# M4: per-pair metric registry (Column builders over hypothesis and reference text)
METRICS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_metric(name: str):
    def deco(fn):
        METRICS[name] = fn
        return fn
    return deco


@register_metric("rouge")
def _rouge_metric(df, hyp, ref):
    from qsumm.operators.rouge import with_rouge
    return with_rouge(df, hyp, ref, max_n=3, alpha=1.0)


@register_metric("bleu_char")
def _bleu_char_metric(df, hyp, ref):
    from qsumm.operators.bleu import characters, sentence_bleu, with_bleu_counts
    return sentence_bleu(with_bleu_counts(df, characters(hyp), characters(ref), unit="char"), out="bleu_char")


def apply_metric(df: DataFrame, name: str, hyp: str, ref: str) -> DataFrame:
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name](df, hyp, ref)
