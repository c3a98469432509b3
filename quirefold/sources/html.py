"""HTML pages as elements: headings, paragraphs, list items and table cells by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a tag's text becomes; text elsewhere is Plain Text, and these tags have none.
KINDS = {"title": "Title", "h1": "Heading", "h2": "Heading", "h3": "Heading", "h4": "Heading", "h5": "Heading", "h6": "Heading", "p": "Paragraph", "li": "List", "td": "Table", "th": "Table", "figcaption": "Figure Caption", "caption": "Table Caption"}
BLOCKS = {*KINDS, "div", "section", "article", "nav", "footer", "header", "main", "aside", "ul", "ol", "table", "tr", "body", "html", "blockquote", "pre", "br", "hr"}
SILENT = {"script", "style", "noscript", "template"}
#: Characters of pages whose blocks are Python objects at one time.
LETTERS_AT_ONCE = 1 << 20


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.rows: list[tuple[str, int, str, str]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            tag = next((t for t in reversed(self.open) if t in KINDS), "")
            level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 1 if tag == "title" else 0
            self.rows.append((KINDS.get(tag, "Plain Text"), level, text, "/".join(t for t in self.open if t in BLOCKS)))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in SILENT or (tag in BLOCKS and tag not in ("br", "hr")):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not any(t in SILENT for t in self.open):
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, int, str, str]]:
    """(element_type, heading_level, text, path) of each text block in order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.rows


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, element_type, heading_level, text, path of the text blocks of pages(page_id, html); pages without an
    id keep a null one, pages without text have no rows. Blocks leave Python every LETTERS_AT_ONCE characters, whatever a batch holds."""

    kinds = pa.schema([("page_id", pa.string()), ("ord", pa.int32()), ("element_type", pa.string()), ("heading_level", pa.int32()), ("text", pa.string()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, letters = [], 0
            for i in range(batch.num_rows):
                page, html = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                out += [(page, n, *row) for n, row in enumerate(blocks_of(html))]
                letters += len(html or "")
                if letters >= LETTERS_AT_ONCE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * len(kinds), kinds.types, strict=True)], schema=kinds)
                    out, letters = [], 0

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInArrow(run, "page_id string, ord int, element_type string, heading_level int, text string, path string").withColumn("page_id", F.col("page_id").cast("long"))
