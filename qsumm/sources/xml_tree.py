"""Crawled XML pages with sections at any depth.

One streaming pass per page in Arrow batches: no tree is kept, only the page's
text and, for every open element, where its text starts.  What a section
lookup needs comes out as one row per page: all titles in document order, each
with its parent's child elements (document position and text) and the parent's
first ``text`` descendant.  Lookup itself is a column expression
(``operators.sections.tree_section``).

A page that is not well-formed, declares entities or nests deeper than
``MAX_DEPTH`` is kept with ``malformed = true`` and nulls.  An element's text is
all text inside it, followed, as XML writers do, by the text up to the next tag.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 1000
BATCH_BYTES = 2 << 20  # page text that is walked before its rows leave a task, about
TITLE = ("struct<title: string, texts: array<string>, children: array<struct<at: int, text: string>>, "
         "first_text: string>")
FIELDS = f"url string, corpus string, id string, full_text string, titles array<{TITLE}>, malformed boolean"


class _Open:
    __slots__ = ("name", "at", "start", "own", "children", "titles", "first_text")

    def __init__(self, name: str, at: int, start: int):
        self.name, self.at, self.start = name, at, start
        self.own = [start]  # where the element's own text begins and ends, in turn
        self.children: list[list] = []  # [position, start, end]
        self.titles: list[dict] = []
        self.first_text = None  # [start, end] of the first text descendant


class PageWalk:
    """Handlers of one page."""

    def __init__(self):
        self.size, self.pieces, self.seen = 0, [], 0
        self.stack: list[_Open] = []
        self.ended: list[list] = []  # spans that wait for the next tag: their tail ends there
        self.root: dict[str, str] = {}
        self.titles: list[dict] = []

    def _tag(self):
        for span in self.ended:
            span[-1] = self.size
        self.ended = []

    def start(self, name: str, attributes: dict) -> None:
        self._tag()
        if len(self.stack) >= MAX_DEPTH:
            raise ValueError("nested too deeply")
        if self.stack:
            self.stack[-1].own.append(self.size)
        else:
            self.root = attributes
        here = _Open(name, self.seen, self.size)
        self.seen += 1
        if name == "title":
            here.titles.append({"own": here.own})
            self.titles.append(here.titles[0])
        self.stack.append(here)

    def text(self, data: str) -> None:
        self.pieces.append(data)
        self.size += len(data)

    def end(self, name: str) -> None:
        self._tag()
        done = self.stack.pop()
        done.own.append(self.size)
        if not self.stack:
            for t in done.titles:
                t.setdefault("children", [])
            return
        parent = self.stack[-1]
        parent.own.append(self.size)
        span = [done.at, done.start, self.size]
        self.ended.append(span)
        parent.children.append(span)
        if done.name == "text":
            # A text element opens before the ones inside it, so it comes first itself.
            first = [done.start, self.size]
            self.ended.append(first)
        else:
            first = done.first_text
        if parent.first_text is None:
            parent.first_text = first
        for t in done.titles:
            t["children"], t["parent"] = parent.children, parent

    def result(self) -> dict:
        self._tag()
        page = "".join(self.pieces)
        titles = []
        for t in self.titles:
            own = [page[a:b] for a, b in zip(t["own"][::2], t["own"][1::2])]
            first = t["parent"].first_text if "parent" in t else None
            titles.append({"title": own[0] or None, "texts": [x for x in own if x],
                           "children": [{"at": at, "text": page[a:b]} for at, a, b in t["children"]],
                           "first_text": None if first is None else page[first[0]:first[1]]})
        return {"url": self.root.get("url"), "corpus": self.root.get("corpus"), "id": self.root.get("id"),
                "full_text": page, "titles": titles, "malformed": False}


BROKEN = {"url": None, "corpus": None, "id": None, "full_text": None, "titles": None, "malformed": True}


def _no_entities(*_):
    raise ValueError("entity declarations are not read")


def walk(document: str | None) -> dict:
    """The fields of one page."""
    page, parser = PageWalk(), expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = page.start, page.end
    parser.CharacterDataHandler, parser.EntityDeclHandler = page.text, _no_entities
    try:
        parser.Parse((document or "").encode("utf-8"), True)
    except (expat.ExpatError, ValueError):
        return BROKEN
    return page.result()


def _slices(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts end within ``limit`` bytes of each other (one
    row at least): a batch holds thousands of pages, their trees several times the text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    block = (np.cumsum(sizes) - sizes) // (limit or BATCH_BYTES)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(lo, hi - lo)


def with_page_tree(df: DataFrame, xml: str) -> DataFrame:
    """``df`` without column ``xml`` and with url, corpus, id, full_text, titles, malformed."""
    others = [c for c in df.columns if c != xml]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    names = ["url", "corpus", "id", "full_text", "titles", "malformed"]
    text = pa.string()
    title = pa.struct([("title", text), ("texts", pa.list_(text)),
                       ("children", pa.list_(pa.struct([("at", pa.int32()), ("text", text)]))), ("first_text", text)])
    types = [text, text, text, text, pa.list_(title), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, xml):
                pages = [walk(x.as_py()) for x in part.column(xml)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), *(pa.array([p[n] for p in pages], t) for n, t in zip(names, types))],
                    [*others, *names])

    return df.mapInArrow(run, f"{schema}{', ' if schema else ''}{FIELDS}")


def read_page_trees(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, any directory depth; ``path`` tells which file."""
    files = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), "value"))
    return with_page_tree(files, "value")
