"""An optional provider of PDF pages and rasters: it needs PyMuPDF where its tasks run, and nothing else does."""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import PAGE_SCHEMA, provide

_CORNERS = ("x1", "y1", "x2", "y2")


def _library() -> ModuleType:
    """PyMuPDF under either of its names."""
    for name in ("pymupdf", "fitz"):
        try:
            return importlib.import_module(name)
        except ModuleNotFoundError as missing:
            if missing.name != name:
                raise
    raise RuntimeError("decoding PDF files needs PyMuPDF on the executors")


def _box(corners) -> dict[str, float]:
    return dict(zip(_CORNERS, map(float, corners), strict=True))


def _span(span: dict) -> dict:
    return {"text": span["text"], "bbox": _box(span["bbox"]), "font": span["font"], "size": float(span["size"]), "flags": int(span["flags"]), "color": int(span["color"])}


def _block(block: dict) -> dict:
    lines = [{"bbox": _box(line["bbox"]), "spans": [_span(s) for s in line["spans"]]} for line in block.get("lines", ())]
    return {"type": int(block["type"]), "bbox": _box(block["bbox"]), "lines": lines}


class _Pdf:
    """Opens each document of (doc_id, content) and asks `page` for the columns of each of its pages; a document that
    cannot be read gives one row that says why."""

    #: Columns between page_number and error.
    columns: tuple[str, ...] = ()

    def page(self, page) -> tuple:
        raise TypeError("a provider says what it takes from a page")

    def rows(self, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = _library()
        names = ["doc_id", "page_number", *self.columns, "error"]
        for batch in batches:
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                try:
                    with library.open(stream=bytes(content or b""), filetype="pdf") as document:
                        for number, page in enumerate(document, 1):  # a page at a time, however long the document
                            yield pd.DataFrame([(doc_id, number, *self.page(page), None)], columns=names).astype(object)
                except Exception as wrong:  # the library raises its own kinds, and one bad file must not end the job
                    empty = [None] * (len(self.columns) + 1)
                    yield pd.DataFrame([(doc_id, *empty, f"{type(wrong).__name__}: {wrong}")], columns=names).astype(object)


class Pages(_Pdf):
    """Decoded pages (PAGE_SCHEMA) for span_elements, numbered from 1, with an error column."""

    schema = f"{PAGE_SCHEMA}, error string"
    columns = ("blocks",)

    def page(self, page) -> tuple:
        return ([_block(b) for b in page.get_text("dict")["blocks"]],)


class Rasters(_Pdf):
    """Pages as PNG images; 144 dpi is twice the size in points."""

    schema = "doc_id long, page_number int, png binary, width int, height int, error string"
    columns = ("png", "width", "height")

    def __init__(self, dpi: int = 144):
        self.dpi = dpi

    def page(self, page) -> tuple:
        pixels = page.get_pixmap(dpi=self.dpi)
        return pixels.tobytes("png"), pixels.width, pixels.height


def pdf_pages(files: DataFrame) -> DataFrame:
    """Pages of files(doc_id, content)."""
    return provide(files.select("doc_id", "content"), Pages)


def pdf_rasters(files: DataFrame, dpi: int = 144) -> DataFrame:
    return provide(files.select("doc_id", "content"), lambda: Rasters(dpi))


def failures(pages: DataFrame) -> DataFrame:
    """doc_id and error of documents that could not be read, for the error sections of a stream."""
    return pages.where(F.col("error").isNotNull()).select("doc_id", "error")
