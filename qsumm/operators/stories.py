"""News-story preparation (P22-P24, J11, K2 inputs, F12).

Story files are found by ``sha1(url).story`` in an ordered list of source
folders (first folder wins); missing stories are reported, not skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qsumm.functions.text import collapse_ws, fix_missing_period, strip_ws

HIGHLIGHT = "@highlight"
CNN_PREFIX = "(CNN)"


def split_story(stories: DataFrame, lines: str = "lines", source: str = "source") -> DataFrame:
    """``article`` = non-blank lines before the first ``@highlight`` line
    joined by spaces (after P22); ``abstract`` = every later non-blank line that is
    not a marker, each as `` s `` joined by spaces.  Stories from the CNN source
    lose a leading ``(CNN)``; the article's whitespace is normalized."""
    fixed = F.transform(F.col(lines), fix_missing_period)
    marks = F.transform(fixed, lambda l: F.startswith(l, F.lit(HIGHLIGHT)))
    first = F.array_position(marks, True)
    n = F.size(fixed)
    before = F.when(first > 0, F.slice(fixed, 1, (first - 1).cast("int"))).otherwise(fixed)
    after = F.when(first > 0, F.slice(fixed, first.cast("int"), (n - first + 1).cast("int"))).otherwise(
        F.array().cast("array<string>"))
    art = F.array_join(F.filter(before, lambda l: l != ""), " ")
    highs = F.filter(after, lambda l: (l != "") & ~F.startswith(l, F.lit(HIGHLIGHT)))
    abstract = F.array_join(F.transform(highs, lambda s: F.concat(F.lit(" "), s, F.lit(" "))), " ")
    art = F.when((F.col(source) == "cnn") & F.startswith(art, F.lit(CNN_PREFIX)), F.substring(art, 6, 1 << 30)).otherwise(art)
    return stories.withColumn("article", strip_ws(collapse_ws(art))).withColumn("abstract", abstract)


def locate_stories(urls: DataFrame, stories: DataFrame, url: str = "url", priority: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Url -> ``sha1(url).story`` -> the story from the first source folder
    holding it.  Returns (found, missing)."""
    priority = priority or {"cnn": 0, "dailymail": 1}
    prio = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])
    keyed = urls.withColumn("file_name", F.concat(F.sha1(F.col(url)), F.lit(".story")))
    cand = stories.withColumn("__prio", F.try_element_at(prio, F.col("source")))
    best = cand.groupBy("file_name").agg(F.min_by(F.struct(*[c for c in stories.columns if c != "file_name"]),
                                                  F.col("__prio")).alias("__s"))
    best = best.select("file_name", "__s.*")
    return keyed.join(best, "file_name", "inner"), keyed.join(best, "file_name", "left_anti")


def line_safe(df: DataFrame, cols) -> DataFrame:
    """rows whose text would break a one-example-per-line file."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    cond = None
    for c in cols:
        x = F.instr(F.col(c), "\n") > 0
        cond = x if cond is None else cond | x
    return df.where(cond)
