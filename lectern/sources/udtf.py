"""Table functions for documents that no built-in reads: comment pages in HTML, as Arrow-batched generators."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_question


class _Comments(HTMLParser):
    """Questions and comments of tables of class `table`: the question is the strong text, a comment the second cell of a body
    row, its link's text if it has one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.depth = self.cell = 0
        self.question, self.into, self.body = "", None, False
        self.cell_text: list[str] = []
        self.link_text: list[str] = []
        self.linked = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            if self.depth or "table" in (dict(attrs).get("class") or "").split():
                self.depth += 1
                if self.depth == 1:
                    self.question, self.body = "", False
        elif not self.depth:
            return
        elif tag == "strong" and not self.question:
            self.into = "strong"
        elif tag == "tbody":
            self.body = True
        elif tag == "tr":
            self.cell = 0
        elif tag == "td" and self.body:
            self.cell += 1
            self.cell_text, self.link_text, self.linked = [], [], False
        elif tag == "a" and self.cell == 2:
            self.linked, self.into = True, "a"

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif not self.depth:
            return
        elif tag in ("strong", "a") and self.into == tag:
            self.into = None
        elif tag == "tbody":
            self.body = False
        elif tag == "td" and self.body and self.cell == 2:
            text = " ".join("".join(self.link_text if self.linked else self.cell_text).split())
            question = " ".join(self.question.split())
            if text and question:
                self.rows.append((question, text))

    def handle_data(self, data: str) -> None:
        if self.into == "strong":
            self.question += data
        elif self.depth and self.cell == 2:
            self.cell_text.append(data)
            if self.into == "a":
                self.link_text.append(data)


def comments_of(html: str | None) -> list[tuple[str, str]]:
    """(question as it stands, comment) of each comment of a page."""
    parser = _Comments()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def comment_rows(pages: DataFrame, url: str = "course_url", html: str = "html") -> DataFrame:
    """course_url, question, comment of each comment on the pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, q, c) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for q, c in comments_of(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], names=["course_url", "question", "comment"])

    found = pages.select(url, html).mapInArrow(read, "course_url string, question string, comment string")
    return found.select("course_url", strip_question(F.col("question")).alias("question"), "comment")
