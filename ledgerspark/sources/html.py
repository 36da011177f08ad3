"""HTML to Markdown with the standard library alone."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .headings import VOID, recovered

# Elements that have no visible text, and those that end a line.
HIDDEN = {"script", "noscript", "svg", "style", "template", "head", "ix:header", "ix:hidden", "ix:exclude"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "blockquote", "pre", "form", "figure", "aside", "dl", "dd", "dt"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Writer(HTMLParser):
    def __init__(self, before: dict[int, str], gone: set[int]):
        super().__init__(convert_charrefs=True)
        self.before, self.gone, self.number = before, gone, 0
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.rows: list[list[str]] = []
        self.tables = 0
        self.lists: list[list] = []

    def _put(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def handle_starttag(self, tag, attrs):
        self.number += 1
        if self.hidden == ["head"] and (tag == "body" or tag in BLOCKS or tag in HEADINGS):
            self.hidden = []  # a head that is never closed ends where the body begins
        if not self.hidden and self.number in self.before:
            title = self.before[self.number]
            self._put(f"\n\n## {title}\n\n" if self.cell is None else f" {title} ")
        if self.number in self.gone and not self.hidden:
            self.hidden.append(tag)
            return
        if self.hidden:
            if tag not in VOID and tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in HEADINGS and self.cell is None:
            self._put("\n\n" + "#" * HEADINGS[tag] + " ")
        elif tag == "br":
            self._put("\n" if self.cell is None else " ")
        elif tag == "hr" and self.cell is None:
            self._put("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n\n" if self.cell is None else " ")
        elif tag == "li":
            level = max(0, len(self.lists) - 1)
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self._put(f"\n{'  ' * level}{mark} " if self.cell is None else " ")
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif tag == "tr" and self.tables == 1:
            self._end_row()
            self.row = []
        elif tag in ("td", "th") and self.tables == 1:
            self._end_cell()
            self.row = [] if self.row is None else self.row
            self.cell = []
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag in BLOCKS:
            self._put("\n\n" if self.cell is None else " ")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in ("td", "th") and self.tables == 1:
            self._end_cell()
        elif tag == "tr" and self.tables == 1:
            self._end_row()
        elif tag == "table" and self.tables:
            if self.tables == 1:
                self._end_row()
                self._table()
            self.tables -= 1
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag in BLOCKS or tag in HEADINGS:
            self._put("\n\n" if self.cell is None else " ")

    def handle_data(self, data):
        if not self.hidden:
            self._put(re.sub(r"\s+", " ", data.replace("\xa0", " ")))

    def _end_cell(self):
        if self.cell is not None:
            self.row.append(re.sub(r"\s+", " ", "".join(self.cell)).strip().replace("|", "\\|"))
            self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            self.rows.append(self.row)
        self.row = None

    def _table(self):
        rows = [r for r in self.rows if any(r)]
        if rows:
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            self.out.append("\n\n" + "\n".join(lines) + "\n\n")
        self.rows = []


def to_markdown(html: str) -> str:
    """Visible text with headings (recovered ones too), lists and tables; at most one blank line in a row."""
    writer = _Writer(*recovered(html))
    writer.feed(html)
    writer.close()
    writer._end_row()
    if writer.rows:
        writer._table()
    text = re.sub(r"[ \t]*\n[ \t]*(?![ \t]*-|\d)", "\n", "".join(writer.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown, na_action="ignore")


def markdown_column(html: Column) -> Column:
    """Null where the html is null; blank where nothing is visible."""
    return F.pandas_udf(_markdown, StringType())(html)
