"""Text scalar functions: ``Column -> Column``, built from JVM built-ins only.

Every function here has a DuckDB twin in ``qsumm.plans.sqltext`` so that the
query catalogue can be checked against SQL.  Character classes are spelled out
(Java, RE2 and Python disagree on ``\\s``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the corpus conventions) -----------------------------
# ASCII whitespace as Python's str.split()/str.strip() see it in this corpus.
WS_CHARS = " \t\n\r\f\x0b"
WS_CLASS = r"[ \t\n\r\f\x0B]"
SENT_START = "<s>"
SENT_END = "</s>"
QUESTION_SEP = " [QUESTION?] "
SUMMARY_END = " [END]"
ARTICLE_SEP = " [ARTICLE_SEP] "
# Line endings accepted as already ending a sentence (story files).
END_TOKENS = [".", "!", "?", "...", "'", "`", '"', "’", "”", ")"]
# -----------------------------------------------------------------------------

_MARK = "\u0001"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """P5: every whitespace run becomes one space."""
    return F.regexp_replace(_c(col), WS_CLASS + "+", " ")


def strip_ws(col) -> Column:
    """Strip leading/trailing whitespace (all ASCII whitespace, not only spaces)."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def newline_to_space(col) -> Column:
    """P7."""
    return F.translate(_c(col), "\n", " ")


def sentences(col) -> Column:
    """Rule sentence splitter -> array<string>.

    A boundary follows ``.``, ``!`` or ``?`` plus whitespace, or is a line break.
    Pieces are stripped and blanks dropped.
    """
    marked = F.regexp_replace(_c(col), r"([.!?])" + WS_CLASS + "+", "$1" + _MARK)
    marked = F.regexp_replace(marked, r"[\n\r]+", _MARK)
    parts = F.split(marked, _MARK)
    return F.filter(F.transform(parts, strip_ws), lambda s: s != F.lit(""))


def tag_sentences(sents) -> Column:
    """``<s> s </s>`` for every sentence, joined by one space."""
    return F.array_join(
        F.transform(_c(sents), lambda s: F.concat(F.lit(SENT_START + " "), s, F.lit(" " + SENT_END))),
        " ")


def with_question(question, article, enabled: bool = True) -> Column:
    """P10: question-driven input."""
    if not enabled:
        return _c(article)
    return F.concat(_c(question), F.lit(QUESTION_SEP), _c(article))


def with_end_tag(summary, enabled: bool = True) -> Column:
    """Append the end marker (before tagging)."""
    return F.concat(_c(summary), F.lit(SUMMARY_END)) if enabled else _c(summary)


def remove_tags(col) -> Column:
    """Drop ``<s>`` and ``</s>`` (the surrounding spaces stay)."""
    return F.replace(F.replace(_c(col), F.lit(SENT_START), F.lit("")), F.lit(SENT_END), F.lit(""))


def ws_tokens(col) -> Column:
    """Whitespace tokens (``str.split()``)."""
    return F.array_remove(F.split(_c(col), WS_CLASS + "+"), "")


def rouge_tokens(col) -> Column:
    """ROUGE tokens: lower case, runs of ``[a-z0-9]``."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("[a-z0-9]+"), F.lit(0))


WORD_PUNCT = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B]"


def word_punct_tokens(col) -> Column:
    """Words (letters/digits) and single punctuation marks."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_PUNCT), F.lit(0))


def ngrams(tokens, n: int) -> Column:
    """N-grams joined with ``_``; empty when fewer than n tokens."""
    t = _c(tokens)
    k = F.size(t) - F.lit(n) + F.lit(1)
    return F.when(k <= 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(t, i, F.lit(n)), "_")))


def tagged_sentences(col) -> Column:
    """Sentences between ``<s>`` and ``</s>`` (stripped); untagged text -> []."""
    return F.transform(F.regexp_extract_all(_c(col), F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1)), strip_ws)


def naive_tag(col) -> Column:
    """Split on every period (keeping the trailing empty piece) and tag each piece."""
    parts = F.split(_c(col), r"\.", -1)
    return F.array_join(
        F.transform(parts, lambda s: F.concat(F.lit(SENT_START + " "), s, F.lit(" " + SENT_END))), " ")


def regroup_decoded(words) -> Column:
    """P20: decoded words -> text where each sentence (ending at a ``.`` token)
    is prefixed by one space.

    Joining all words with spaces and prefixing one space gives the same
    string, because sentence pieces are themselves joined with single spaces.
    """
    w = _c(words)
    return F.when(F.size(w) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.array_join(w, " ")))


def decoded_sentences(words) -> Column:
    """P20 (list form): words grouped into sentences, each ending at a ``.`` token."""
    w = _c(words)
    joined = F.array_join(F.transform(w, lambda x: F.when(x == ".", F.lit(".\u0001")).otherwise(
        F.concat(x, F.lit(" ")))), "")
    parts = F.split(joined, _MARK)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^ +| +$", "")),
                    lambda p: p != F.lit(""))


def join_reference(sents) -> Column:
    """P21."""
    return F.array_join(_c(sents), ". ")


def fix_missing_period(line) -> Column:
    """Add a period unless blank, a highlight marker, or already ended."""
    ln = _c(line)
    last = F.substring(ln, -1, 1)
    return (F.when(F.instr(ln, "@highlight") > 0, ln)
            .when(ln == "", ln)
            .when(last.isin(*END_TOKENS), ln)
            .otherwise(F.concat(ln, F.lit("."))))


def html_safe(col) -> Column:
    """P25: escape ``<`` and ``>``."""
    return F.replace(F.replace(_c(col), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cut_at_stop(words, stop: str = "[STOP]") -> Column:
    """Words before the first stop token (all when absent)."""
    w = _c(words)
    pos = F.array_position(w, stop)
    return F.when(pos > 0, F.slice(w, F.lit(1), (pos - 1).cast("int"))).otherwise(w)
