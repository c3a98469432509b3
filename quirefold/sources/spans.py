"""PDF text spans from decoded pages, provider protocols for what Spark cannot decode, and saved results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import style
from ..functions.geometry import Box
from ..functions.text import normal

#: A decoded page: blocks of lines of spans, as PDF libraries return it.
PAGE_SCHEMA = "doc_id long, page_number int, blocks array<struct<type:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>,lines:array<struct<bbox:struct<x1:double,y1:double,x2:double,y2:double>,spans:array<struct<text:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,font:string,size:double,flags:int,color:int>>>>>>"
#: A saved extraction result, one document a line.
RESULT_SCHEMA = "elements array<struct<id:long,element_type:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text:string,metadata:map<string,string>>>, metadata map<string,string>"


class Provider(Protocol):
    """Decodes files or runs a model: rows of one partition in, rows out. Instances are made once per task."""

    schema: str

    def rows(self, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def provide(inputs: DataFrame, make) -> DataFrame:
    """Rows of the provider that `make()` returns, made where it runs (page decoding, rasters, detectors, outlines,
    format conversion, embeddings)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from make().rows(batches)

    return inputs.mapInPandas(run, make().schema)


def span_elements(pages: DataFrame, per_page: bool = False) -> DataFrame:
    """Elements of decoded pages (PAGE_SCHEMA): one per non-blank text span, image blocks left out.

    element_id runs through the document from 1; per_page counts from 0 on each page. Pages without text give no rows.
    """
    blocks = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_number", "block")).where("coalesce(block.type, 0) = 0")
    lines = blocks.select("*", F.posexplode("block.lines").alias("line_number", "line"))
    spans = lines.select("*", F.posexplode("line.spans").alias("span_number", "span")).where(normal(F.col("span.text")).isNotNull())
    bold, italic = style.is_bold(F.col("span.font"), F.col("span.flags")), style.is_italic(F.col("span.font"), F.col("span.flags"))
    order = Window.partitionBy("doc_id", *(["page_number"] if per_page else [])).orderBy("page_number", "block_number", "line_number", "span_number")
    return spans.select(
        "doc_id", "page_number", (F.row_number().over(order) - (1 if per_page else 0)).alias("element_id"), F.lit("Plain Text").alias("element_type"), F.lit(1.0).alias("confidence"),
        *[F.col(f"span.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], normal(F.col("span.text")).alias("text"), F.col("span.font").alias("font_name"), F.col("span.size").alias("font_size"),
        bold.alias("bold"), italic.alias("italic"), style.is_underlined(F.col("span.font"), F.col("span.flags")).alias("underline"), style.hex_color(F.col("span.color")).alias("color"),
        style.alignment(F.col("block.bbox.x1"), F.col("block.bbox.x2"), F.col("line.bbox.x1"), F.col("line.bbox.x2")).alias("alignment"), style.style_name(F.col("span.size"), bold, italic).alias("style_name"),
        style.pdf_heading_level(F.col("span.size"), bold).alias("heading_level"), "block_number", "line_number",
    )


def rescaled(elements: DataFrame, factor: float) -> DataFrame:
    """Boxes times a factor: 72 / dpi from pixels to points, dpi / 72 back."""
    return elements.withColumns(dict(zip(("x1", "y1", "x2", "y2"), Box.of().scaled(factor), strict=True)))


def detections(rows: DataFrame, least: float = 0.25, dpi: float | None = None) -> DataFrame:
    """Detector output (doc_id, page_number, class_id, confidence, box) as elements in reading order of each page."""
    from ..operators.merge import group_lines

    kept = rows.where(F.col("confidence") >= least).withColumn("element_type", style.detector_type(F.col("class_id")))
    kept = rescaled(kept, 72 / dpi) if dpi else kept
    kept = kept.withColumn("element_id", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("y1", "x1", "x2", "y2", "class_id")) - 1)
    order = Window.partitionBy("doc_id", "page_number").orderBy("line", "pos")
    return group_lines(kept).withColumn("element_id", F.row_number().over(order) - 1).drop("line", "pos", "class_id")


def saved_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Elements of saved results: path, element columns, metadata as a map."""
    whole = spark.read.schema(RESULT_SCHEMA).json(list(paths), multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.explode("elements").alias("e"))
    return whole.select("path", F.col("e.id").alias("element_id"), "e.element_type", "e.confidence", *[F.col(f"e.bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], normal(F.col("e.text")).alias("text"), F.map_filter("e.metadata", lambda k, v: v.isNotNull()).alias("metadata"))


def save_results(elements: DataFrame, path: str) -> None:
    """One JSON document per doc_id with its elements in order."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    one = F.struct(F.col("element_id").alias("id"), "element_type", "confidence", box, "text")
    elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("elements")).write.json(path)
