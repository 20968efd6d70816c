"""Tables of HTML pages as rows: table number, row number, nearest headings and cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Tables(HTMLParser):
    """Collects (kind, table, row, heading or cells) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, str | None, list[str] | None]] = []
        self.table = self.row = -1
        self.cells: list[list[str]] | None = None
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _HEADINGS:
            self.heading = []
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._end_row()
            self.row, self.cells = self.row + 1, []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append([])

    def handle_endtag(self, tag):
        if tag in _HEADINGS and self.heading is not None:
            self.found.append(("heading", self.table, -1, " ".join(self.heading), None))
            self.heading = None
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if text := data.strip():
            if self.cells:
                self.cells[-1].append(text)
            elif self.heading is not None:
                self.heading.append(text)

    def _end_row(self):
        if self.cells is not None:
            self.found.append(("row", self.table, self.row, None, [" ".join(c) for c in self.cells]))
            self.cells = None


_ROWS = "source_id string, pos long, kind string, table_no long, row_no long, heading string, cells array<string>"
_SCHEMA = pa.schema([("source_id", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("table_no", pa.int64()), ("row_no", pa.int64()), ("heading", pa.string()), ("cells", pa.list_(pa.string()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source, body in zip(*(c.to_pylist() for c in batch.columns)):
            reader = _Tables()
            reader.feed(body or "")
            reader.close()
            rows += [(source, k, *x) for k, x in enumerate(reader.found)]
        columns = zip(*rows) if rows else [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def page_tables(pages: DataFrame) -> DataFrame:
    """Headings and table rows of each page (source_id, body), with their place."""
    return pages.select("source_id", "body").mapInArrow(_parse, _ROWS)


def markdown_lines(pages: DataFrame) -> DataFrame:
    """(source_id, pos, line) of each line of each page."""
    return pages.select("source_id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))


def pipe_sections(lines: DataFrame, cells, is_header) -> DataFrame:
    """Data rows of Markdown tables: rows after the first header of each run of pipe lines, with that header.

    The line right after the header (its separator) is left out, and so are separators
    and rows shorter than the header.
    """
    from tariffgrid.functions.text import is_separator

    ordered = W.partitionBy("source_id").orderBy("pos")
    marked = lines.withColumn("cells", cells).withColumn("run", F.sum((F.size("cells") == 0).cast("int")).over(ordered))
    rows = marked.where(F.size("cells") > 0).withColumn("head", F.when(is_header(F.col("cells")), F.struct("pos", "cells")))
    run = W.partitionBy("source_id", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    headed = rows.withColumn("head", F.first("head", ignorenulls=True).over(run))
    return headed.where(F.col("head").isNotNull() & (F.col("pos") > F.col("head.pos") + 1) & ~is_separator(F.col("cells")) & (F.size("cells") >= F.size("head.cells"))).withColumn("header", F.col("head.cells")).drop("head", "run")
