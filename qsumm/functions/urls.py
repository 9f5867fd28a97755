"""Url helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that mean "no value" in the question-answer sheet.
NA_URL = ["n/a", "NA"]
NA_SECTION = ["n/a", "NA", "none", ""]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def doc_id_from_url(url) -> Column:
    """Last ``/`` segment."""
    return F.element_at(F.split(_c(url), "/", -1), -1)


def after_scheme(url) -> Column:
    return F.split_part(_c(url), F.lit("//"), F.lit(2))


def short_site(url) -> Column:
    """First dot-part of the part after ``//``; the second when the first is ``www``."""
    parts = F.split(after_scheme(url), r"\.", -1)
    return F.when(F.element_at(parts, 1) == "www", F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1))


def host(url) -> Column:
    """Text after ``//`` up to the next ``/`` (null when ``//`` is missing)."""
    u = _c(url)
    return F.when(F.instr(u, "//") > 0, F.split_part(after_scheme(u), F.lit("/"), F.lit(1)))


def na_url(url) -> Column:
    """Url missing markers -> NULL."""
    u = _c(url)
    return F.when(u.isin(*NA_URL), F.lit(None).cast("string")).otherwise(u)


def na_section(section) -> Column:
    """Section missing markers -> NULL."""
    s = _c(section)
    return F.when(s.isin(*NA_SECTION), F.lit(None).cast("string")).otherwise(s)
