"""Joining fragments: lines of boxes, greedy merging of text fragments, and enrichment of boxes by spans."""

from __future__ import annotations

import re
from collections import namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PAGE = ["doc_id", "page_number"]
LINE_STEP = 0.5


def group_lines(boxes: DataFrame, step: float = LINE_STEP) -> DataFrame:
    """Adds line (from 0 on its page) and pos (from left in its line).

    A line begins at a box more than `step` below the first box of the line before; the line's height stays that of its
    first box, so this is a fold over each page's distinct heights. Boxless rows go.
    """
    heights = boxes.where("y1 is not null").select(*PAGE, "y1").distinct()
    folded = heights.groupBy(*PAGE).agg(F.array_sort(F.collect_list("y1")).alias("ys"))
    zero = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<y1:double,line:int>>").alias("out"))

    def step_on(s, y):
        new = s["top"].isNull() | (y > s["top"] + step)
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(line.alias("line"), F.when(new, y).otherwise(s["top"]).cast("double").alias("top"), F.concat(s["out"], F.array(F.struct(y.cast("double").alias("y1"), line.alias("line")))).alias("out"))

    lines = folded.select(*PAGE, F.inline(F.aggregate("ys", zero, step_on, lambda s: s["out"])))
    at = Window.partitionBy(*PAGE, "line").orderBy("x1", "element_id")
    return boxes.join(lines, [*PAGE, "y1"]).withColumn("pos", F.row_number().over(at) - 1)


#: Fixed values of merging: share by which font sizes may differ, and distances in font sizes: one line's height, gap
#: across, shift of centres, gap down, and where a scan ends.
SIZES, LINE, ACROSS, CENTRE, DOWN, FAR = 1.1, 0.3, 0.5, 0.7, 1.5, 5
_FIELDS = ("element_id", "element_type", "confidence", "x1", "y1", "x2", "y2", "text", "font_name", "font_size", "bold", "italic")
Fragment = namedtuple("Fragment", _FIELDS)


def _same_font(a, b) -> bool:
    if a.font_name and b.font_name and a.font_name != b.font_name:
        if re.sub("[^a-z]", "", a.font_name.lower()) != re.sub("[^a-z]", "", b.font_name.lower()):
            return False
    if a.font_size and b.font_size and max(a.font_size, b.font_size) > SIZES * min(a.font_size, b.font_size):
        return False
    return bool(a.bold) == bool(b.bold) and bool(a.italic) == bool(b.italic)


def _mean_size(a, b) -> float:
    return ((a.font_size or 12.0) + (b.font_size or 12.0)) / 2


def _close(a, b) -> bool:
    size = _mean_size(a, b)
    if abs(a.y1 - b.y1) <= LINE * size:
        return min(abs(a.x2 - b.x1), abs(b.x2 - a.x1)) <= ACROSS * size
    if abs((a.x1 + a.x2) - (b.x1 + b.x2)) / 2 <= CENTRE * size:
        return min(abs(a.y2 - b.y1), abs(b.y2 - a.y1)) <= DOWN * size
    return False


def continues(first: str, second: str) -> bool:
    """Does the second text go on where the first ends?"""
    first, second = first.strip(), second.strip()
    if not first or not second:
        return True
    capital = second[0].isupper()
    if not capital and (first.endswith("-") or not first.endswith((".", "!", "?", ":", ";"))):
        return True
    if re.match(r"(\d+|[a-zA-Z])\.?\s*", first):
        return False  # list items stay apart
    return len(first) < 3 or len(second) < 3


def joined_text(texts: list[str]) -> str:
    """Texts joined by spaces; a hyphen at the end of one closes up with the next."""
    out = ""
    hyphen = False
    for text in (t.strip() for t in texts):
        if text:
            out = out.rstrip("-") + text if hyphen and out else f"{out} {text}" if out and not out.endswith(" ") else out + text
        hyphen = text.endswith("-")
    return out.strip()


MERGED = "element_id long, element_type string, confidence double, x1 double, y1 double, x2 double, y2 double, text string, font_name string, font_size double, bold boolean, italic boolean, n_merged int, original_texts array<string>"


def merged(rest: list) -> list[dict]:
    """A page's fragments, in order, merged greedily."""
    out, used = [], [False] * len(rest)
    for i, first in enumerate(rest):
        if used[i]:
            continue
        group, last = [first], first
        for j in range(i + 1, len(rest)):
            if used[j]:
                continue
            other = rest[j]
            # The nearest test first: most of a page is neither close nor far.
            if _close(last, other) and _same_font(last, other) and continues(last.text or "", other.text or ""):
                group.append(other)
                used[j], last = True, other
            else:
                far = FAR * _mean_size(last, other)
                if abs(last.y1 - other.y1) > far or abs(last.x1 - other.x1) > far:
                    break
        group.sort(key=lambda e: (e.y1, e.x1, e.element_id))
        lead, kinds = group[0], [e.element_type for e in group]
        out.append(lead._asdict() | {
            "element_type": max(sorted(set(kinds), key=str), key=kinds.count), "confidence": min(e.confidence for e in group),
            "x1": min(e.x1 for e in group), "y1": min(e.y1 for e in group), "x2": max(e.x2 for e in group), "y2": max(e.y2 for e in group),
            "text": joined_text([e.text or "" for e in group]), "n_merged": len(group), "original_texts": [e.text for e in group],
        })
    return out


#: Pages that are Python objects at one time.
PAGES_AT_ONCE = 64
_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
_MERGED = T.ArrayType(T.StructType([T.StructField(*(name, _KINDS[kind])) for name, kind in (field.split() for field in MERGED.split(", "))]))


@F.arrow_udf(_MERGED)
def _fold(pages: pa.Array) -> pa.Array:
    """merged for each page. Only a few pages of a batch are Python objects at a time, the rest stays Arrow data."""
    kind, out = to_arrow_type(_MERGED), []
    for lo in range(0, len(pages), PAGES_AT_ONCE):
        some = pages.slice(lo, PAGES_AT_ONCE).to_pylist()
        out.append(pa.array([merged([Fragment(*[e[c] for c in _FIELDS]) for e in page]) for page in some], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


def merge_fragments(spans: DataFrame) -> DataFrame:
    """Fragments of running text on a page merged greedily, in order of (y1, x1, element_id).

    From each fragment not yet used, later ones join while fonts agree, boxes lie close and the text goes on; the scan
    ends at the first fragment more than five font sizes away. Folded page by page: on documents of one page this equals
    a scan of the whole document. The merged row has the union of boxes, the least confidence, the most frequent type
    (ties: the first by name) and the id and style of its first fragment. A page is one row on its way through Python.
    """
    kinds = {"element_id": "long", "element_type": "string", "text": "string", "font_name": "string", "bold": "boolean", "italic": "boolean"}
    rows = spans.select(*PAGE, F.struct(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in ("y1", "x1", "element_id", *[c for c in _FIELDS if c not in ("y1", "x1", "element_id")])]).alias("e"))

    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return pages.select(*PAGE, F.inline(_fold("es")))


def enrich(pairs: DataFrame, collapse: bool = False) -> DataFrame:
    """Boxes with the text and runs of their spans, from match_spans: per box the texts in order of span id (joined as
    they are; collapse removes all white space), its runs with offsets in that text, and font of the first span."""
    text = F.coalesce(F.col("s_text"), F.lit(""))
    text = F.regexp_replace(text, r"(?U)\s+", "") if collapse else text
    before = Window.partitionBy(*PAGE, "b_element_id").orderBy("s_element_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = pairs.withColumn("__t", text).withColumn("__at", F.coalesce(F.sum(F.length("__t")).over(before), F.lit(0)))
    run = F.struct(F.col("s_element_id").alias("span_id"), F.col("__t").alias("text"), F.col("__at").alias("start_index"), (F.col("__at") + F.length("__t")).alias("end_index"), F.col("s_font_name").alias("font_name"), F.col("s_font_size").alias("font_size"))
    runs = F.array_sort(F.collect_list(F.when(F.col("s_element_id").isNotNull(), run)))
    grouped = offset.groupBy(*PAGE, F.col("b_element_id").alias("element_id")).agg(runs.alias("runs"))
    return grouped.select("*", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), F.size("runs").alias("n_runs"), F.get("runs", F.lit(0))["font_name"].alias("font_name"), F.get("runs", F.lit(0))["font_size"].alias("font_size"))
