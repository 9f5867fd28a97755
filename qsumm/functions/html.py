"""HTML page helpers (P28 and the section list used by P29/P30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qsumm.functions.text import collapse_ws, strip_ws

# Entity decoding table (``&amp;`` is decoded last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

DROP_BLOCKS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
HEADING_OPEN = r"(?i)<h[1-6][^>]*>"
HEADING_CLOSE = r"(?i)</h[1-6]\s*>"
_MARK = "\u0001"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_entities(col) -> Column:
    out = _c(col)
    for k, v in ENTITIES:
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def markup_to_text(col) -> Column:
    """Tags to spaces, entities decoded, whitespace collapsed and stripped."""
    no_tags = F.regexp_replace(_c(col), TAG, " ")
    return strip_ws(collapse_ws(decode_entities(no_tags)))


def raw_text(col) -> Column:
    """Extracted text of markup before white space is collapsed: tags vanish, entities are decoded."""
    return decode_entities(F.regexp_replace(_c(col), TAG, ""))


def html_text(col) -> Column:
    """Flatten a page to text (scripts, styles and comments dropped)."""
    return markup_to_text(F.regexp_replace(_c(col), DROP_BLOCKS, " "))


def page_title(col) -> Column:
    return markup_to_text(F.regexp_extract(_c(col), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_sections(col) -> Column:
    """Sections of a page as ``array<struct<title,text>>`` in document order.

    A section starts at a heading ``<h1>``..``<h6>``; its text is everything up
    to the next heading.  Content before the first heading is not a section.
    """
    clean = F.regexp_replace(_c(col), DROP_BLOCKS, " ")
    marked = F.regexp_replace(clean, HEADING_OPEN, _MARK)
    pieces = F.split(marked, _MARK, -1)
    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(body, lambda p: F.struct(
        markup_to_text(F.regexp_extract(p, r"(?is)^(.*?)</h[1-6]", 1)).alias("title"),
        markup_to_text(F.regexp_replace(p, r"(?is)^.*?</h[1-6]\s*>", "")).alias("text"),
    ))


def html_sections_raw(col) -> Column:
    """Like ``html_sections`` but the section body keeps its markup (``raw``), for
    length rules measured before any cleaning."""
    clean = F.regexp_replace(_c(col), DROP_BLOCKS, " ")
    marked = F.regexp_replace(clean, HEADING_OPEN, _MARK)
    pieces = F.split(marked, _MARK, -1)
    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(body, lambda p: F.struct(
        markup_to_text(F.regexp_extract(p, r"(?is)^(.*?)</h[1-6]", 1)).alias("title"),
        F.regexp_replace(p, r"(?is)^.*?</h[1-6]\s*>", "").alias("raw"),
    ))
