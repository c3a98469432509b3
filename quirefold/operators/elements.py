"""Filters, orders and summaries of element tables (doc_id, page_number, element_id, element_type, confidence, x1..y2, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.text import normal, ordered_text

PAGE = ["doc_id", "page_number"]


def with_confidence(elements: DataFrame, least: float = 0.5) -> DataFrame:
    """Elements of at least this confidence; 0.0 keeps all."""
    return elements.where(F.col("confidence") >= least)


def of_types(elements: DataFrame, *types: str) -> DataFrame:
    return elements.where(F.col("element_type").isin(*types))


def without_types(elements: DataFrame, *types: str) -> DataFrame:
    return elements.where(~F.col("element_type").isin(*types))


def on_page(elements: DataFrame, page: int) -> DataFrame:
    """One page, or all for -1; a page that does not exist gives no rows."""
    return elements if page == -1 else elements.where(F.col("page_number") == page)


def valid_and_rejected(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose box and confidence hold, and the rest; boxless rows are valid."""
    good = F.coalesce(Box.of().valid, F.lit(True)) & F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    return elements.where(good), elements.where(~good)


def type_counts(elements: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return elements.groupBy(*by, "element_type").agg(F.count("*").alias("n"))


def confidence_stats(elements: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Least, most, mean and interpolated median; zeros where no confidence is known."""
    c = F.col("confidence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return elements.groupBy(*by).agg(
        zero(F.min(c)).alias("least"), zero(F.max(c)).alias("most"), zero(F.avg(c)).alias("mean"), zero(F.percentile(c, F.lit(0.5))).alias("median"), F.count("*").alias("n")
    )


def document_text(elements: DataFrame, separator: str = "\n") -> DataFrame:
    """Non-blank texts of each document in order of ord, joined. A document without text gives ''."""
    return elements.groupBy("doc_id").agg(ordered_text(F.col("ord"), normal(F.col("text")), separator).alias("text"))


def document_summary(elements: DataFrame) -> DataFrame:
    """Per document: elements, by source where there is one, pages, and elements with text."""
    sources = [F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}") for s in ("cv", "pdf")] if "source" in elements.columns else []
    has_text = [F.count(normal(F.col("text"))).alias("n_text")] if "text" in elements.columns else []
    return elements.groupBy("doc_id").agg(F.count("*").alias("n_elements"), F.count_distinct("page_number").alias("n_pages"), *sources, *has_text)


def pages(elements: DataFrame) -> DataFrame:
    """Elements per page."""
    return elements.groupBy(*PAGE).agg(F.count("*").alias("n"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Adds ord, from top to bottom and left to right within a document; documents with a boxless element keep theirs."""
    whole = F.min(F.col("x1").isNotNull().cast("int")).over(Window.partitionBy("doc_id")) == 1
    key = lambda c: F.when(F.col("__whole"), F.col(c))
    by = Window.partitionBy("doc_id").orderBy(key("y1"), key("x1"), "element_id")
    return elements.withColumn("__whole", whole).withColumn("ord", F.row_number().over(by) - 1).drop("__whole")


def renumber(elements: DataFrame, *order: str, by: tuple[str, ...] = ("doc_id",), start: int = 0) -> DataFrame:
    """New element_ids in this order, from start."""
    return elements.withColumn("element_id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + start)


def by_area(elements: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Adds the rank of each element by area, largest first."""
    return elements.withColumn("area_rank", F.row_number().over(Window.partitionBy(*by).orderBy(Box.of().area.desc(), "element_id")))
