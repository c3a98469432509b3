"""DOCX files by the standard library: paragraphs and tables with their styles, as element rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.style import docx_heading_level

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Justification names of the format and the alignment they stand for.
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "distribute"}
SCHEMA = "path string, ord int, element_type string, text string, style string, alignment string, font_name string, font_size double, bold boolean, italic boolean, underline boolean, n_runs int, n_rows int, n_cols int, x1 double, y1 double, x2 double, y2 double, left_indent double, right_indent double, first_line_indent double, space_before double, space_after double, keep_together boolean, keep_with_next boolean, page_break_before boolean, widow_control boolean, error string"
_EMPTY = (None,) * 8
_NO_FORMAT = (None,) * 9


def _on(props, tag: str) -> bool | None:
    node = None if props is None else props.find(_W + tag)
    return None if node is None else node.get(_W + "val", "true") not in ("0", "false", "none")


def _font(run) -> tuple:
    props = run.find(_W + "rPr")
    name = size = None
    if props is not None:
        fonts, half = props.find(_W + "rFonts"), props.find(_W + "sz")
        name = None if fonts is None else fonts.get(_W + "ascii") or fonts.get(_W + "eastAsia")
        size = None if half is None else float(half.get(_W + "val")) / 2
    return name, size, _on(props, "b"), _on(props, "i"), _on(props, "u")


def _points(node, *names: str) -> float | None:
    """The first of these measures that is set, from twentieths of a point."""
    for name in () if node is None else names:
        value = node.get(_W + name)
        if value is not None:
            return float(value) / 20
    return None


def _format(p) -> tuple:
    """Indents and distances of a paragraph in points, and how it keeps together; a hanging first line is negative.
    What the paragraph does not set itself is null."""
    props = p.find(_W + "pPr")
    if props is None:
        return _NO_FORMAT
    ind, space = props.find(_W + "ind"), props.find(_W + "spacing")
    hanging = _points(ind, "hanging")
    first = _points(ind, "firstLine") if hanging is None else -hanging
    return (
        _points(ind, "left", "start"), _points(ind, "right", "end"), first, _points(space, "before"), _points(space, "after"),
        _on(props, "keepLines"), _on(props, "keepNext"), _on(props, "pageBreakBefore"), _on(props, "widowControl"),
    )


def _text(node) -> str:
    return "".join("\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else t.text or "" for t in node.iter() if t.tag in (_W + "t", _W + "tab", _W + "br"))


def _paragraph(p, names: dict[str, str]) -> tuple:
    props = p.find(_W + "pPr")
    style = jc = None
    if props is not None:
        s, j = props.find(_W + "pStyle"), props.find(_W + "jc")
        style = None if s is None else names.get(s.get(_W + "val"), s.get(_W + "val"))
        jc = None if j is None else ALIGNMENTS.get(j.get(_W + "val"), "unknown")
    runs = [r for r in p.iter(_W + "r") if _text(r)]
    return _text(p), style or "Normal", jc, *(_font(runs[0]) if runs else (None,) * 5), len(runs)


def read_document(content: bytes) -> list[tuple]:
    """Rows after `path` of SCHEMA: non-blank paragraphs in order, then non-empty tables (cells by tabs, rows by breaks)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for s in ElementTree.fromstring(archive.read("word/styles.xml")).iter(_W + "style"):
                n = s.find(_W + "name")
                names[s.get(_W + "styleId")] = s.get(_W + "styleId") if n is None else n.get(_W + "val")
    out: list[tuple] = []
    for place, p in enumerate(body.findall(_W + "p")):
        text, *rest = _paragraph(p, names)
        if text.strip():
            out.append((len(out), "Paragraph", text, *rest, None, None, 0.0, place * 20.0, 500.0, place * 20.0 + 15, *_format(p), None))
    for table in body.findall(_W + "tbl"):
        rows = [["\n".join(_text(p) for p in c.findall(_W + "p")).strip() for c in r.findall(_W + "tc")] for r in table.findall(_W + "tr")]
        if any(any(r) for r in rows):
            first = next(((*q[1:], _format(p)) for p in table.iter(_W + "p") if (q := _paragraph(p, names))[0].strip()), None)
            top = len(out) * 20.0
            out.append((len(out), "Table", "\n".join("\t".join(r) for r in rows), *(first[:-1] if first else _EMPTY), len(rows), max(map(len, rows)), 0.0, top, 500.0, top + 50, *(first[-1] if first else _NO_FORMAT), None))
    return out


def docx_elements(files: DataFrame) -> DataFrame:
    """Elements of files(path, content). A file that cannot be read gives one row with `error` and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows = [(path, *r) for r in read_document(bytes(content or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, ValueError) as wrong:
                    rows = [(path, *[None] * (len(names) - 2), f"{type(wrong).__name__}: {wrong}")]
                yield pd.DataFrame(rows, columns=names).astype(object)

    out = files.select("path", "content").mapInPandas(run, SCHEMA)
    return out.withColumn("heading_level", F.when(F.col("error").isNull(), docx_heading_level(F.col("style"))))


def docx_text(files: DataFrame) -> DataFrame:
    """path and the non-blank paragraphs joined by line breaks; '' for files that cannot be read."""
    from ..functions.text import ordered_text

    kept = F.when(F.col("element_type") == "Paragraph", F.col("text"))
    return docx_elements(files).groupBy("path").agg(F.coalesce(ordered_text(F.col("ord"), kept), F.lit("")).alias("text"))


def docx_structure(files: DataFrame) -> DataFrame:
    """path, ord, text, is_heading, level (number at the end of a heading style, else 1; null for text), style."""
    heading = F.lower("style").contains("heading")
    level = F.coalesce(F.element_at(F.split("style", " "), -1).try_cast("int"), F.lit(1))
    return docx_elements(files).where("element_type = 'Paragraph'").select("path", "ord", "text", heading.alias("is_heading"), F.when(heading, level).alias("level"), "style")
