"""Spatial joins, all equi-joined on (doc_id, page_number) with geometry as the residual, and greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import style
from ..functions.geometry import Box, associated, center_inside, contains
from ..functions.text import strip

PAGE = ["doc_id", "page_number"]


def _sided(rows: DataFrame, prefix: str) -> DataFrame:
    """Columns other than the page key under a prefix."""
    return rows.select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c not in PAGE])


def match_spans(boxes: DataFrame, spans: DataFrame) -> DataFrame:
    """Left join of detected boxes (b_) to the text spans (s_) that belong to them; a span may belong to several boxes,
    and spans of no box are left out."""
    b, s = _sided(boxes, "b_"), _sided(spans, "s_")
    same = (b.doc_id == s.doc_id) & (b.page_number == s.page_number)
    near = associated(Box(b.b_x1, b.b_y1, b.b_x2, b.b_y2), Box(s.s_x1, s.s_y1, s.s_x2, s.s_y2))
    return b.join(s, same & near, "left").drop(s.doc_id).drop(s.page_number)


def match_spans_banded(boxes: DataFrame, spans: DataFrame, band: float = 64.0) -> DataFrame:
    """match_spans for dense pages: both sides are cut in horizontal bands, so only neighbours in height are compared.

    A pair that shares several bands is taken in the first of them.
    """
    def banded(rows: DataFrame, p: str) -> DataFrame:
        lo, hi = F.floor(F.col(f"{p}y1") / band), F.floor(F.col(f"{p}y2") / band)
        return rows.withColumn(f"{p}low", lo).withColumn("band", F.explode(F.sequence(lo, hi)))

    b, s = banded(_sided(boxes, "b_"), "b_"), banded(_sided(spans, "s_"), "s_")
    near = associated(Box.of("b_"), Box.of("s_")) & (F.col("band") == F.greatest("b_low", "s_low"))
    pairs = b.join(s, [*PAGE, "band"]).where(near).drop("band", "b_low", "s_low")
    rest = _sided(boxes, "b_").join(pairs.select(*PAGE, "b_element_id"), [*PAGE, "b_element_id"], "left_anti")
    return pairs.unionByName(rest, allowMissingColumns=True)


def table_of_elements(elements: DataFrame, tables: DataFrame, zoom: float = 1.0) -> DataFrame:
    """Adds table_id, the last table (largest table_id) that an element's box contains; null without one."""
    t = _sided(tables, "t_")
    outer, inner = Box.of(), Box.of("t_").scaled(zoom)
    pairs = elements.select(*PAGE, "element_id", "x1", "y1", "x2", "y2").join(t, PAGE).where(contains(outer, inner))
    last = pairs.groupBy(*PAGE, "element_id").agg(F.max("t_table_id").alias("table_id"))
    return elements.join(last, [*PAGE, "element_id"], "left")


def chars_in_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters joined to the cells that hold their middle, numbered within the cell from top to bottom, left to right."""
    c = _sided(cells, "c_")
    pairs = chars.join(c, PAGE).where(center_inside(Box.of(), Box.of("c_")))
    order = Window.partitionBy(*PAGE, "c_table_id", "c_row", "c_col").orderBy("y1", "x1", "char_id")
    return pairs.withColumn("pos", F.row_number().over(order) - 1)


def nearby_underlines(spans: DataFrame, drawings: DataFrame) -> DataFrame:
    """Drawn lines that begin within 10 points of a span's top in height and from 10 points before it to 50 after it."""
    d = _sided(drawings, "d_")
    near = F.abs(F.col("d_y1") - F.col("y1")).between(0, 10) & (F.col("d_x1") >= F.col("x1") - 10) & (F.col("d_x1") <= F.col("x2") + 50)
    return spans.join(d, PAGE).where(near).select(
        *PAGE, "element_id", "d_drawing_id", (F.col("d_x2") - F.col("d_x1")).alias("length"), style.underline_length(F.col("d_x1"), F.col("d_x2")).alias("underscores"), (F.abs(F.col("d_y2") - F.col("d_y1")) < 2).alias("is_horizontal")
    )


#: Single signs that count as superscripts.
SIGNS = ("*", "†", "‡", "§", "¶", "°", "™", "®", "©")


def is_superscript(text: Column, size: Column) -> Column:
    """At least two of: font below 10, three characters at most, digits only, a sign, a number in brackets."""
    t = strip(F.coalesce(text, F.lit("")))
    signs = [F.coalesce(size < 10, F.lit(False)), F.length(t) <= 3, t.rlike(r"^\d+$"), t.isin(*SIGNS), t.rlike(r"^[\(\[]?\d+[\)\]]?$")]
    return sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2


def superscript_anchors(spans: DataFrame) -> DataFrame:
    """(page, element_id, main_id) of superscripts and the text each follows: the best by score, then by nearness."""
    s = _sided(spans.where(is_superscript(F.col("text"), F.col("font_size"))), "s_")
    m = _sided(spans, "m_")
    across, down = F.col("s_x1") - F.col("m_x2"), F.abs(F.col("m_y1") - F.col("s_y1"))
    beside = (F.col("s_element_id") != F.col("m_element_id")) & (F.col("m_x2") <= F.col("s_x2")) & (F.col("m_y1") >= F.col("s_y1") - 5) & (F.col("m_y1") <= F.col("s_y2") + 10) & across.between(0, 50)
    smaller = F.coalesce(F.col("s_font_size") / F.nullif(F.col("m_font_size"), F.lit(0)) < 0.8, F.lit(False))
    score = 1.0 / (1.0 + across + down * 2) * F.when(smaller, 1.5).otherwise(1.0)
    best = F.min_by("m_element_id", F.struct((-score).alias("s"), across.alias("a"), down.alias("d"), F.col("m_element_id").alias("i")))
    return s.join(m, PAGE).where(beside).groupBy(*PAGE, F.col("s_element_id").alias("element_id")).agg(best.alias("main_id"))


def order_with_superscripts(spans: DataFrame) -> DataFrame:
    """Adds ord within the document: reading order, superscripts right after the text they belong to."""
    at = spans.select(*PAGE, F.col("element_id").alias("main_id"), F.col("y1").alias("__y"), (F.col("x1") + 0.1).alias("__x"))
    placed = spans.join(superscript_anchors(spans), [*PAGE, "element_id"], "left").join(at, [*PAGE, "main_id"], "left")
    order = Window.partitionBy("doc_id").orderBy("page_number", F.coalesce("__y", "y1"), F.coalesce("__x", "x1"), "element_id")
    return placed.withColumn("ord", F.row_number().over(order) - 1).drop("__y", "__x")


def suppress_overlaps(boxes: DataFrame, most: float = 0.9) -> DataFrame:
    """Boxes that survive greedy suppression on their page: in order of area, largest first, a box falls if more than
    `most` of the smaller of the two lies in common with a box already kept.

    Greedy, so each page (never a document) is folded, by array functions in the JVM; ties of area go to the smaller
    element_id. A box that falls does not suppress others. Boxless rows stay.
    """
    corners = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    area = Box.of().area.cast("double")
    one = F.struct((-area).alias("order"), F.col("element_id").alias("element_id"), *corners, area.alias("area"))
    ranked = boxes.where("x1 is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    side = lambda k, b, lo, hi: F.greatest(F.least(k[hi], b[hi]) - F.greatest(k[lo], b[lo]), F.lit(0.0))
    hides = lambda k, b: (side(k, b, "x1", "x2") * side(k, b, "y1", "y2") > most * F.least(k["area"], b["area"])) & (b["area"] > 0)
    none = F.array().cast(ranked.schema["boxes"].dataType)
    kept = F.aggregate("boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: hides(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    survivors = ranked.select(*PAGE, F.explode(kept).alias("box")).select(*PAGE, F.col("box.element_id").alias("element_id"))
    return boxes.join(survivors, [*PAGE, "element_id"], "left_semi").unionByName(boxes.where("x1 is null"))
