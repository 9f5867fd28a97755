"""Section lookup inside a joined page row.

The requested section string is a column, never spliced into an XPath, so
titles with quotes are safe.  Matching runs with higher-order functions over
the page's section array: no cross join, no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pick_section(df: DataFrame, sections: str, wanted: str, title: str = "title") -> DataFrame:
    """Adds ``exact`` (sections whose title equals ``wanted``), ``loose`` (title
    contains it, case-insensitive), ``hit`` (first exact, else first loose) and
    ``match_kind`` in {exact, contains, none, missing}; a null or empty wanted
    title is missing and matches nothing."""
    s, w = _c(sections), F.nullif(_c(wanted), F.lit(""))
    exact = F.filter(s, lambda z: z[title] == w)
    loose = F.filter(s, lambda z: F.contains(F.lower(z[title]), F.lower(w)))
    out = df.withColumn("exact", exact).withColumn("loose", loose)
    has_exact = F.coalesce(F.size("exact"), F.lit(-1)) > 0
    has_loose = F.coalesce(F.size("loose"), F.lit(-1)) > 0
    return (out.withColumn("hit", F.when(has_exact, F.element_at("exact", 1))
                           .when(has_loose, F.element_at("loose", 1)))
               .withColumn("match_kind", F.when(w.isNull(), "missing").when(has_exact, "exact")
                           .when(has_loose, "contains").otherwise("none")))


def xml_section_text(df: DataFrame, sections: str, wanted: str, corpus: str, answer: str,
                     exempt_corpus: str = "DailyMed") -> DataFrame:
    """P29/P30/F2/F3 for crawled XML pages whose sections are
    ``array<struct<title, children: array<string>, text>>``.

    Exact title: the text is the second child of the first matching section,
    accepted only when the matching sections have exactly two children in total
    (the exempt corpus is always accepted).  Otherwise the first section whose
    title contains the wanted string (case-insensitive) gives its first text.
    The section is kept only when its raw length is at least the answer's.
    """
    s, w = _c(sections), F.nullif(_c(wanted), F.lit(""))
    exact = F.filter(s, lambda z: z["title"] == w)
    n_children = F.aggregate(exact, F.lit(0), lambda acc, z: acc + F.size(z["children"]))
    exact_ok = (F.size(exact) > 0) & ((n_children == 2) | (_c(corpus) == exempt_corpus))
    exact_text = F.try_element_at(F.try_element_at(exact, F.lit(1))["children"], F.lit(2))
    loose = F.filter(s, lambda z: F.contains(F.lower(z["title"]), F.lower(w)))
    loose_text = F.try_element_at(loose, F.lit(1))["text"]
    raw = F.when(F.size(exact) > 0, F.when(exact_ok, exact_text)).otherwise(loose_text)
    return (df.withColumn("section_raw", raw)
              .withColumn("section_kind", F.when(F.size(exact) > 0, F.when(exact_ok, "exact").otherwise("rejected"))
                          .when(F.size(loose) > 0, "contains").otherwise("none"))
              .withColumn("section_text", F.when(F.length("section_raw") >= F.length(_c(answer)),
                                                 F.regexp_replace("section_raw", r"[ \t\n\r\f\x0B]+", " "))))


def tree_section(df: DataFrame, wanted: str, answer: str, titles: str = "titles", corpus: str = "corpus",
                 exempt_corpus: str = "DailyMed") -> DataFrame:
    """P29/P30/F2/F3/F4 on the titles of ``sources.xml_tree`` (any depth).

    Exact: some text node of a title equals ``wanted``; the child elements of all
    such titles' parents, in document order and each once, must number exactly
    two (the exempt corpus may have more), and the second is the section.  Without
    an exact title the first title whose leading text contains ``wanted``, in any
    case, gives the first ``text`` descendant of its parent.  Adds ``section_raw``,
    ``section_kind`` (missing, exact, rejected, contains, short, none) and
    ``section_text`` (white space collapsed; null unless the raw section is at
    least as long as the answer)."""
    t, w = _c(titles), F.nullif(_c(wanted), F.lit(""))
    exact = F.coalesce(F.filter(t, lambda z: F.exists(z["texts"], lambda x: x == w)), F.array())
    loose = F.coalesce(F.filter(t, lambda z: F.contains(F.lower(z["title"]), F.lower(w))), F.array())
    out = (df.withColumn("__w", w).withColumn("__exact", exact)
           .withColumn("__children", F.array_sort(F.array_distinct(F.flatten(F.transform("__exact", lambda z: z["children"])))))
           .withColumn("__loose", loose))
    n = F.size("__children")
    fits = (n == 2) | ((_c(corpus) == exempt_corpus) & (n >= 2))
    raw = (F.when(F.size("__exact") > 0, F.when(fits, F.try_element_at("__children", F.lit(2))["text"]))
           .otherwise(F.try_element_at("__loose", F.lit(1))["first_text"]))
    kind = (F.when(F.col("__w").isNull(), "missing").when((F.size("__exact") > 0) & ~F.coalesce(fits, F.lit(False)), "rejected")
            .when(F.col("section_raw").isNull(), "none").when(~F.col("__long"), "short")
            .when(F.size("__exact") > 0, "exact").otherwise("contains"))
    return (out.withColumn("section_raw", F.when(F.col("__w").isNotNull(), raw))
            .withColumn("__long", F.coalesce(F.length("section_raw") >= F.length(_c(answer)), F.lit(False)))
            .withColumn("section_kind", kind)
            .withColumn("section_text", F.when(F.col("__long"), F.regexp_replace("section_raw", r"[ \t\n\r\f\x0B]+", " ")))
            .drop("__w", "__exact", "__children", "__loose", "__long"))
