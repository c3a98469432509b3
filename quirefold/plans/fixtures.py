"""Layout tables derived from the star schema by plain arithmetic, the same in Spark and in SQL.

The driver's tables hold no PDF or DOCX bytes, so boxes, spans, characters and table cells come from orders, parts and
nations; lines and outlines come from documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import style
from ..operators import outline
from ..sources.lines import line_elements


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key() -> dict:
    k = F.col("o_orderkey")
    return {"doc_id": F.expr("o_orderkey div 200"), "page_number": (F.expr("o_orderkey div 40") % 5 + 1).cast("int"), "element_id": k % 200}


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes, 40 a page, five pages a document; every fifth repeats the one before, moved by a point."""
    k0 = F.col("o_orderkey")
    k = k0 - F.when(k0 % 5 == 4, 1).otherwise(0)
    x1, y1 = ((k * 37) % 500 + (k0 - k)).cast("double"), ((k * 91) % 700).cast("double")
    return read(spark, sf_dir, "orders").select(
        *[c.alias(n) for n, c in _key().items()],
        style.detector_type(k0 % 10).alias("element_type"),
        (((k0 * 29) % 101) / 100.0).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"), ((k * 37) % 500 + 20 + (k * 13) % 180).cast("double").alias("x2"), ((k * 91) % 700 + 8 + (k * 7) % 40).cast("double").alias("y2"),
    )


BOXES = f"""boxes AS (
  SELECT o_orderkey // 200 AS doc_id, CAST((o_orderkey // 40) % 5 + 1 AS INT) AS page_number, o_orderkey % 200 AS element_id,
         [{', '.join(repr(t) for t in style.DETECTOR_CLASSES)}][o_orderkey % 10 + 1] AS element_type,
         ((o_orderkey * 29) % 101) / 100.0::DOUBLE AS confidence,
         CAST((k * 37) % 500 + (o_orderkey - k) AS DOUBLE) AS x1, CAST((k * 91) % 700 AS DOUBLE) AS y1,
         CAST((k * 37) % 500 + 20 + (k * 13) % 180 AS DOUBLE) AS x2, CAST((k * 91) % 700 + 8 + (k * 7) % 40 AS DOUBLE) AS y2
  FROM (SELECT o_orderkey, o_orderkey - CASE WHEN o_orderkey % 5 = 4 THEN 1 ELSE 0 END AS k FROM orders))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans in four columns and ten rows a page; names of parts are their text, brands their fonts."""
    k0 = F.col("o_orderkey")
    slot = k0 % 40
    x1, y1 = 50 + (slot % 4) * 120, 60 + F.expr("(o_orderkey % 40) div 4") * 18
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_brand").alias("font_name"))
    n = part.count()
    placed = read(spark, sf_dir, "orders").select(
        *[c.alias(n_) for n_, c in _key().items()], (k0 % n).alias("p_partkey"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 60 + (k0 * 17) % 60).cast("double").alias("x2"), (y1 + 12).cast("double").alias("y2"),
        (8 + k0 % 12).cast("double").alias("font_size"), (k0 % 32).cast("int").alias("flags"), ((k0 * 7919) % 16777216).alias("color_value"),
    )
    return placed.join(part, "p_partkey").drop("p_partkey")


SPANS = """spans AS (
  SELECT doc_id, page_number, element_id, x1, y1, x2, y2, font_size, flags, color_value, p_name AS text, p_brand AS font_name
  FROM (SELECT o_orderkey // 200 AS doc_id, CAST((o_orderkey // 40) % 5 + 1 AS INT) AS page_number, o_orderkey % 200 AS element_id,
               o_orderkey % (SELECT count(*) FROM part) AS pk,
               CAST(50 + (o_orderkey % 40 % 4) * 120 AS DOUBLE) AS x1, CAST(60 + (o_orderkey % 40 // 4) * 18 AS DOUBLE) AS y1,
               CAST(50 + (o_orderkey % 40 % 4) * 120 + 60 + (o_orderkey * 17) % 60 AS DOUBLE) AS x2, CAST(60 + (o_orderkey % 40 // 4) * 18 + 12 AS DOUBLE) AS y2,
               CAST(8 + o_orderkey % 12 AS DOUBLE) AS font_size, CAST(o_orderkey % 32 AS INT) AS flags, (o_orderkey * 7919) % 16777216 AS color_value
        FROM orders) JOIN part ON p_partkey = pk)"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with the style columns that encodings need."""
    s = spans(spark, sf_dir)
    bold, italic = style.is_bold(F.col("font_name"), F.col("flags")), style.is_italic(F.col("font_name"), F.col("flags"))
    aligned = style.alignment(F.lit(50.0) + (F.col("element_id") % 4) * 120, F.lit(170.0) + (F.col("element_id") % 4) * 120, F.col("x1"), F.col("x2"))
    return s.withColumns({"bold": bold, "italic": italic, "underline": style.is_underlined(F.col("font_name"), F.col("flags")), "alignment": aligned, "element_type": style.detector_type(F.col("element_id") % 10), "confidence": F.lit(1.0)})


STYLED = SPANS + """, styled AS (
  SELECT *, flags & 16 <> 0 OR regexp_matches(lower(font_name), 'bold|black|heavy') AS bold, flags & 2 <> 0 OR regexp_matches(lower(font_name), 'italic|oblique') AS italic,
         flags & 1 <> 0 OR contains(lower(font_name), 'underline') AS underline,
         CASE WHEN abs((x1 - bx) - (bx + 120 - x2)) <= 5 THEN 'center' WHEN bx + 120 - x2 <= 5 AND x1 - bx > 10 THEN 'right'
              WHEN (x2 - x1) / 120 > 0.9 THEN 'justify' ELSE 'left' END AS alignment,
         """ + f"[{', '.join(repr(t) for t in style.DETECTOR_CLASSES)}][element_id % 10 + 1] AS element_type" + """
  FROM (SELECT *, 50.0::DOUBLE + (element_id % 4) * 120 AS bx FROM spans))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_elements(read(spark, sf_dir, "documents"))


LINES = """lines AS (
  SELECT doc_id, row_number() OVER w - 1 AS ord, text,
         coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
  WHERE trim(text, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line))"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline by rule: lines of at most 40 characters are titles."""
    return outline.short_lines_as_titles(lines(spark, sf_dir))


TITLES = LINES + """, titles AS (
  SELECT *, length(token) - length(replace(token, '.', '')) AS level, rtrim(token, '.') AS number
  FROM (SELECT doc_id, title_idx, ord AS element_ord, text AS title,
               (title_idx // 3 + 1) || CASE title_idx % 3 WHEN 0 THEN '.' WHEN 1 THEN '.1' ELSE '.1.1' END AS token
        FROM (SELECT doc_id, ord, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS title_idx FROM lines WHERE length(text) <= 40)))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the cells of one table, five a row."""
    return read(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("table_id"), F.expr("cast(n_nationkey div 5 as int)").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"), F.col("n_name").alias("text"))


CELLS = "cells AS (SELECT CAST(0 AS BIGINT) AS doc_id, 1 AS page_number, 0 AS table_id, CAST(n_nationkey // 5 AS INT) AS row, CAST(n_nationkey % 5 AS INT) AS col, n_name AS text FROM nation)"


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the cells' texts, 4 points wide, in changing styles."""
    letters = cells(spark, sf_dir).select("*", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "c"))
    x1 = (F.col("col") * 100 + F.col("i") * 4).cast("double")
    return letters.select(
        "doc_id", "page_number", (F.col("row") * 10000 + F.col("col") * 100 + F.col("i")).alias("char_id"), x1.alias("x1"), (F.col("row") * 20.0).alias("y1"), (x1 + 4).alias("x2"), (F.col("row") * 20.0 + 10).alias("y2"),
        F.col("c").alias("text"), F.lit("Sans").alias("font_name"), F.when(F.col("i") < 3, 12.0).otherwise(10.0).alias("font_size"), (F.col("i") % 4 == 0).alias("bold"), F.lit(False).alias("italic"),
    )


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = F.col("col") * 100.0, F.col("row") * 20.0
    return cells(spark, sf_dir).select("doc_id", "page_number", "table_id", "row", "col", left.alias("x1"), top.alias("y1"), (left + 100).alias("x2"), (top + 20).alias("y2"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 7) -> DataFrame:
    """The outline of each document cut every few characters, with an end marker."""
    from ..functions.text import ordered_text

    whole = titles(spark, sf_dir).groupBy("doc_id").agg(ordered_text(F.col("title_idx"), F.concat_ws(" ", "token", "title")).alias("outline"))
    parts = F.sequence(F.lit(0), F.floor((F.length("outline") - 1) / size))
    cut = whole.select("doc_id", "outline", F.explode(parts).alias("seq"))
    body = cut.select("doc_id", "seq", F.substr("outline", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), F.lit(False).alias("is_end"))
    end = whole.select("doc_id", (F.floor((F.length("outline") - 1) / size) + 1).alias("seq"), F.lit("").alias("chunk"), F.lit(True).alias("is_end"))
    return body.union(end)
