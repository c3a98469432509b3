"""Plain text documents as elements: one per non-blank line, with running character offsets and synthetic boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

LINE_HEIGHT, BOX_HEIGHT, BOX_WIDTH = 20, 15, 500


def line_elements(documents: DataFrame) -> DataFrame:
    """doc_id, ord, text, char_start, char_end, x1..y2 of the non-blank lines of documents(doc_id, text).

    Offsets count the characters of the lines kept, plus one for each break. The box of a line stands for its place:
    20 points a line, 15 high, 500 wide. A null text has no lines.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(strip(F.col("text")) != "")
    order = Window.partitionBy("doc_id").orderBy("line")
    length = F.length("text")
    start = F.coalesce(F.sum(length + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lines.withColumns({"ord": F.row_number().over(order) - 1, "char_start": start}).withColumn("char_end", F.col("char_start") + length)
    top = (F.col("line") * LINE_HEIGHT).cast("double")
    return out.select("doc_id", "ord", "text", "char_start", "char_end", F.lit(0.0).alias("x1"), top.alias("y1"), F.lit(float(BOX_WIDTH)).alias("x2"), (top + BOX_HEIGHT).alias("y2"))


def joined_text(rows: DataFrame, separator: str = "\n") -> DataFrame:
    """Non-blank texts of rows(doc_id, ord, text) in order, joined: paragraphs by line breaks, pages by empty lines."""
    from ..functions.text import normal, ordered_text

    return rows.groupBy("doc_id").agg(F.coalesce(ordered_text(F.col("ord"), normal(F.col("text")), separator), F.lit("")).alias("text"))
