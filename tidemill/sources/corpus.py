"""Documents and web pages as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemill.functions.types import ref

# Text kept for a model's context and the note that marks a cut.
CONTEXT_CHARS = 30_000
CUT_NOTE = "\n\n[... Content truncated for analysis. First 30,000 characters shown.]"


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """Text files as (path, text), undecodable bytes replaced."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def truncate_for_context(df: DataFrame, column: str = "text", limit: int = CONTEXT_CHARS) -> DataFrame:
    """Cut longer texts to ``limit`` characters and say so; shorter ones stay as they are."""
    text = ref(column)
    cut = F.concat(F.substring(text, 1, limit), F.lit(CUT_NOTE))
    shown = F.when(F.length(text) > limit, cut).otherwise(text)
    return df.select(*[shown.alias(c) if c == column else ref(c) for c in df.columns])


class _Tables(HTMLParser):
    """Collects the cell grid of every table in document order, inner tables included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[dict] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipping += 1
        elif tag == "table":
            rows: list = []
            self.tables.append(rows)
            self.open.append({"rows": rows, "row": None, "cell": None})
        elif self.open and tag == "tr":
            self._close_cell()
            row: list = []
            self.open[-1]["row"] = row
            self.open[-1]["rows"].append(row)
        elif self.open and tag in ("td", "th") and self.open[-1]["row"] is not None:
            self._close_cell()
            spans = [self._span(attrs, name) for name in ("colspan", "rowspan")]
            self.open[-1]["cell"] = ([], *spans)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipping = max(0, self.skipping - 1)
        elif not self.open:
            return
        elif tag in ("td", "th"):
            self._close_cell()
        elif tag == "tr":
            self._close_cell()
            self.open[-1]["row"] = None
        elif tag == "table":
            self._close_cell()
            self.open.pop()

    def handle_data(self, data):
        if not self.skipping:
            for table in self.open:
                if table["cell"]:
                    table["cell"][0].append(data)

    @staticmethod
    def _span(attrs, name):
        value = dict(attrs).get(name) or "1"
        return max(1, int(value)) if value.isdigit() else 1

    def _close_cell(self):
        table = self.open[-1]
        if table["cell"]:
            parts, columns, rows = table["cell"]
            text = re.sub(r"[\r\n]+|\s{2,}", " ", "".join(parts).strip())
            table["row"].append((text, columns, rows))
            table["cell"] = None


def _grid(rows) -> list[list[str]]:
    """Cells repeated over the columns and rows they span."""
    held: dict[int, tuple[str, int]] = {}
    grid = []
    for row in rows:
        line: list[str] = []
        following: dict[int, tuple[str, int]] = {}

        def place_held():
            while len(line) in held:
                text, left = held[len(line)]
                if left > 1:
                    following[len(line)] = (text, left - 1)
                line.append(text)

        for text, columns, spanned in row:
            place_held()
            for _ in range(columns):
                if spanned > 1:
                    following[len(line)] = (text, spanned - 1)
                line.append(text)
        place_held()
        held = following
        grid.append(line)
    return grid


def page_tables(html: str | None) -> list[list[list[str]]]:
    """The non-empty tables of one page as grids of text."""
    if not html or "<table" not in html.lower():
        return []
    parser = _Tables()
    parser.feed(html)
    while parser.open:
        parser._close_cell()
        parser.open.pop()
    grids = [_grid([r for r in rows if r]) for rows in parser.tables]
    return [g for g in grids if g]


def html_tables(df: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Every row of every HTML table: page id, table and row number, cells.

    Pages without a table are dropped before any text leaves the engine.
    """
    pages = df.select(ref(id_column), ref(html_column).alias("_html")).where(F.col("_html").rlike("(?i)<table"))
    schema = T.StructType(
        [
            df.schema[id_column],
            T.StructField("table_idx", T.IntegerType()),
            T.StructField("row_idx", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.StringType())),
        ]
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, t, r, cells)
                for page, html in zip(batch[id_column], batch["_html"])
                for t, grid in enumerate(page_tables(html))
                for r, cells in enumerate(grid)
            ]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return pages.mapInPandas(parse, schema)
