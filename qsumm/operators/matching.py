"""Passage-in-document containment without a cross join.

Candidate generation is an equi-join on one *anchor* of each passage, chosen so
that every document containing the passage is guaranteed to produce it:

- passages of three or more whitespace tokens: every run of tokens strictly inside
  the passage is a run of whole tokens of each containing document.  The passage's
  inner runs of four tokens (two or one, if it has no more) are counted in all
  documents and the rarest is the anchor; a passage with a run that no document
  has is in none.  Common words alone thus make no document a candidate;
- shorter passages: each of their tokens lies inside one whitespace token of
  a containing document, so the first (up to) three characters of the
  passage's longest token are a character gram of some document token.  This
  branch explodes character grams of the documents' distinct tokens and only
  runs when such passages exist.

Candidates are then verified with an exact substring test.

Scale notes
- the passage table is size-checked once; its runs, anchors and texts are
  broadcast only when they are within bounds, otherwise the joins shuffle on the
  run and AQE splits hot ones (skew join); counts are summed before the shuffle;
- the documents' runs carry only ``doc_id`` and a 64-bit hash (never the text) and are
  made in one pass; those that some passage has go to the checkpoint folder, each once
  per document, for the counts and the candidates; equal hashes of different runs only
  add candidates;
- the candidate pairs are written to the checkpoint folder and broadcast for
  the verification scan only when their size is proven small; otherwise they
  are joined with a shuffle on ``doc_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsumm.functions.text import ws_tokens
from qsumm.plans.joins import DEFAULT_BROADCAST_BYTES, DEFAULT_BROADCAST_ROWS, sized_broadcast
from qsumm.session import cut_lineage

GRAM = 3
RUNS = (4, 2, 1)  # tokens of an anchor, the most that a passage has


def _longest(tokens) -> F.Column:
    return F.element_at(F.array_sort(F.transform(tokens, lambda t: F.struct(
        (-F.length(t)).alias("nl"), t.alias("t")))), 1)["t"]


def _inner(text) -> F.Column:
    """The whitespace tokens strictly inside a passage."""
    toks = ws_tokens(text)
    return F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))


def run_length(text) -> F.Column:
    """Tokens of a passage's anchor; NULL under three tokens."""
    have = F.size(_inner(text))
    return F.coalesce(*[F.when(have >= n, F.lit(n)) for n in RUNS])


def _runs(df: DataFrame, tokens: F.Column, lengths: list[int], *keys) -> DataFrame:
    """``keys`` and ``__run``, the hash of every run of ``lengths`` tokens.  The runs come
    out of one generator over shifted slices, so hashing them is compiled with the scan."""
    shifts = [F.slice(F.col("__tok"), i + 1, F.size("__tok")).alias(f"__t{i}") for i in range(max(lengths))]
    rows = df.select(*keys, tokens.alias("__tok")).select(*keys, F.inline(F.arrays_zip(*shifts)))
    hashes = [F.when(F.col(f"__t{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"__t{i}") for i in range(n)]))
              for n in lengths]
    run = hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))
    return rows.select(*keys, run.alias("__run")).where("__run is not null")


def rarest_runs(docs: DataFrame, passages: DataFrame, lengths: list[int], bc=lambda d: d) -> tuple[DataFrame, DataFrame]:
    """``docs`` (__dk, __dt) as ``(__dk, __run)``, once per document row, for the runs that
    some passage has, and ``passages`` (__pk, __pt) as ``(__pk, __run)`` with the run that
    the fewest documents have; passages with a run in no document are left out.
    ``lengths``: the run lengths that occur; ``bc`` broadcasts what grows with the
    passages, if that is bounded.  The documents are read and hashed once: the runs
    found in them are kept in the checkpoint folder for the count and the pairs."""
    need = run_length(F.col("__pt"))
    wanted = reduce(DataFrame.unionByName, [
        _runs(passages.where(need == n), _inner(F.col("__pt")), [n], "__pk") for n in lengths]).distinct()
    rows = docs.withColumn("__row", F.monotonically_increasing_id())  # repeated rows count one by one
    found = _runs(rows, ws_tokens(F.col("__dt")), lengths, "__row", "__dk")
    # dealt by what a retried task finds again; its row numbers may be others then
    found = found.join(bc(wanted.select("__run").distinct()), "__run").repartition("__dk", "__run")
    doc_runs = cut_lineage(found.distinct()).select("__dk", "__run")
    counted = doc_runs.groupBy("__run").agg(F.count(F.lit(1)).alias("__df"))
    rarest = (wanted.join(counted, "__run", "left").groupBy("__pk")
              .agg(F.min_by("__run", F.struct("__df", "__run")).alias("__run"),
                   F.bool_and(F.col("__df").isNotNull()).alias("__all")))
    return doc_runs, rarest.where("__all").select("__pk", "__run")


def short_anchor(text) -> F.Column:
    """For passages of one or two tokens: the first ``GRAM`` characters of the
    longest token."""
    toks = ws_tokens(text)
    return F.when((F.size(toks) >= 1) & (F.size(toks) < 3), F.substring(_longest(toks), 1, GRAM))


def _token_grams(tok: F.Column) -> F.Column:
    """Character grams of length 1..GRAM of a token."""
    n = F.length(tok)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), n)), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(tok, i, k))))
    return F.when(n > 0, grams).otherwise(F.array().cast("array<string>"))


def passage_matches(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id",
                    doc_text: str = "text", pas_key: str = "item_id", pas_text: str = "text",
                    checkpoint: bool = True, keep_text: bool = False) -> DataFrame:
    """All ``(pas_key, doc_key)`` pairs where the passage text occurs in the document
    (with ``keep_text``: also ``doc_text`` as ``article`` and ``pas_text`` as ``summary``)."""
    pas = passages.select(F.col(pas_key).alias("__pk"), F.col(pas_text).alias("__pt"))
    # one aggregate over all passages: size for broadcasting, kinds of passages
    probe = pas.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("__pt") + 16).alias("b"),
        F.sum(F.size(ws_tokens(F.col("__pt")))).alias("t"),
        F.count(short_anchor(F.col("__pt"))).alias("short"),
        *[F.count_if(run_length(F.col("__pt")) == n).alias(f"r{n}") for n in RUNS]).first()
    small = max(probe["n"], probe["t"] or 0) <= DEFAULT_BROADCAST_ROWS and (probe["b"] or 0) <= DEFAULT_BROADCAST_BYTES
    bc = F.broadcast if small else (lambda d: d)
    texts = docs.select(F.col(doc_key).alias("__dk"), F.col(doc_text).alias("__dt"))
    lengths = [n for n in RUNS if probe[f"r{n}"] > 0] or [1]
    # documents' runs are distinct and every passage has one anchor: pairs are unique
    doc_runs, anchors = rarest_runs(texts, pas, lengths, bc)
    cand = doc_runs.join(bc(anchors), "__run").select("__dk", "__pk")
    if probe["short"] > 0:
        shorts = pas.select("__pk", short_anchor(F.col("__pt")).alias("__g")).where(F.col("__g").isNotNull())
        doc_toks = texts.select("__dk", F.explode(F.array_distinct(ws_tokens(F.col("__dt")))).alias("__tok"))
        grams = doc_toks.select("__dk", F.explode(F.array_distinct(_token_grams(F.col("__tok")))).alias("__g"))
        cand = cand.unionByName(grams.join(bc(shorts), "__g").select("__dk", "__pk")).distinct()
    if checkpoint:
        cand = cut_lineage(cand)
    cand = sized_broadcast(cand)
    hits = (texts.join(cand, "__dk").join(bc(pas), "__pk")
            .where(F.instr(F.col("__dt"), F.col("__pt")) > 0))
    cols = [F.col("__pk").alias(pas_key), F.col("__dk").alias(doc_key)]
    if keep_text:
        cols += [F.col("__dt").alias("article"), F.col("__pt").alias("summary")]
    return hits.select(*cols)
