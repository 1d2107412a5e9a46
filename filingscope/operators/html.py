"""A tokenising reader of HTML: text, and tables with their rows and cells, nested ones on their own."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag's attributes; quoted values may hold any sign, > too. Values of over 4000 signs count as unquoted, so the time is linear.
_ATTRIBUTES = r"""(?:"[^"]{0,4000}"|'[^']{0,4000}'|[^'">])*"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>\"']*)(?:{_ATTRIBUTES}>|[^>]*>)|<[!?][^>]*>", re.S | re.I)
#: Characters of the text before a table that go with it.
BEFORE = 300


@dataclass
class Table:
    before: str = ""
    depth: int = 0
    #: Rows of cells: (text, whether it is a heading).
    rows: list[list[tuple[str, bool]]] = field(default_factory=list)


@dataclass
class _Open:
    table: Table
    row: list | None = None
    cell: list | None = None
    heading: bool = False

    def close_cell(self) -> None:
        if self.cell is not None:
            self.row.append((clean("".join(self.cell)), self.heading))
            self.cell = None

    def close_row(self) -> None:
        self.close_cell()
        if self.row is not None:
            self.table.rows.append(self.row)
            self.row = None


def clean(text: str) -> str:
    return " ".join(text.split())


class _Page:
    """The elements that are open while a page is read."""

    def __init__(self):
        self.text: list[str] = []
        self.since: list[str] = []
        self.tables: list[Table] = []
        self.open: list[_Open] = []

    def words(self, text: str) -> None:
        self.text.append(text)
        self.since.append(text)
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(text)

    def tag(self, name: str, closing: bool) -> None:
        here = self.open[-1] if self.open else None
        if name == "table" and not closing:
            table = Table(clean("".join(self.since[-200:]))[-BEFORE:], len(self.open))
            self.tables.append(table)
            self.open.append(_Open(table))
            self.since = []
        elif here is None:
            return
        elif name == "table":
            here.close_row()
            self.open.pop()
            self.since = []
        elif name == "tr":
            here.close_row()
            here.row = None if closing else []
        elif name in ("td", "th"):
            here.close_cell()
            if not closing:
                here.row = [] if here.row is None else here.row
                here.cell, here.heading = [], name == "th"


def read_html(html: str | None) -> tuple[str, list[Table]]:
    """(text, tables in the order in which they begin).

    Comments, scripts, styles and noscript are left out; every tag parts words; entities, numeric ones too, are
    decoded. What stands in a nested table belongs to its cells and not to the outer cell's. Elements that are not
    closed end where the next of their kind begins, or with the table, or the page.
    """
    page, at, html = _Page(), 0, html or ""
    for token in _TOKEN.finditer(html):
        page.words(unescape(html[at : token.start()]) + " ")
        at = token.end()
        if token[3]:
            page.tag(token[3].lower(), bool(token[2]))
    page.words(unescape(html[at:]))
    for element in page.open:
        element.close_row()
    return clean("".join(page.text)), page.tables


def parse_html(docs: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, text, rows): rows has (table, depth, row, cells) of all tables of a page, in Arrow batches."""

    @F.pandas_udf("text string, rows array<struct<table: int, depth: int, row: int, cells: array<string>>>")
    def read(pages: pd.Series) -> pd.DataFrame:
        out = []
        for html in pages:
            text, tables = read_html(html)
            rows = [{"table": t, "depth": x.depth, "row": r, "cells": [c for c, _ in cells]} for t, x in enumerate(tables) for r, cells in enumerate(x.rows)]
            out.append((text, rows))
        return pd.DataFrame(out, columns=["text", "rows"])

    return docs.select(*keys, read(html_col).alias("_p")).select(*keys, "_p.text", "_p.rows")
