"""Table cells: style runs of characters, reconstruction, Markdown and record text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE = ["doc_id", "page_number", "table_id"]
STYLE = ["font_name", "font_size", "bold", "italic"]


def style_runs(chars: DataFrame, cell: list[str]) -> DataFrame:
    """Characters (pos, text and style) of each cell as runs of one style: run_no, text, start_index, end_index, style."""
    order = Window.partitionBy(*cell).orderBy("pos")
    look = F.struct(*STYLE)
    new = F.coalesce((~look.eqNullSafe(F.lag(look).over(order))).cast("int"), F.lit(1))
    numbered = chars.withColumn("__new", new).withColumn("run_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    length = F.length("text")
    numbered = numbered.withColumn("__at", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    return numbered.groupBy(*cell, "run_no").agg(text.alias("text"), F.min("__at").alias("start_index"), F.max(F.col("__at") + length).alias("end_index"), *[F.first(c).alias(c) for c in STYLE])


def rows_of_tables(cells: DataFrame) -> DataFrame:
    """Tables as arrays of rows of cell texts, in order; a null text is an empty cell that is not counted in n_cells."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    rows = cells.groupBy(*TABLE, "row").agg(texts.alias("texts"), F.count("text").alias("n"), F.count("*").alias("wide"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda x: x["texts"])
    return rows.groupBy(*TABLE).agg(ordered.alias("rows"), F.count("*").alias("n_rows"), F.max("wide").alias("n_cols"), F.sum("n").alias("n_cells"))


def markdown(rows: Column) -> Column:
    """Pipe table: header, rule, body; '' without rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(rows[0], lambda c: F.lit("---")))
    whole = F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n")).otherwise("")


def record_text(rows: Column, n_cols: Column) -> Column:
    """`Table with R rows and C columns`, then `Row i: Cell[i,j]: text; ...`, counted from 1."""
    head = F.concat(F.lit("Table with "), F.size(rows).cast("string"), F.lit(" rows and "), n_cols.cast("string"), F.lit(" columns"))

    def one(r: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        cells = F.transform(r, lambda c, j: F.concat(F.lit("Cell["), number, F.lit(","), (j + 1).cast("string"), F.lit("]: "), c))
        return F.concat(F.lit("Row "), number, F.lit(": "), F.array_join(cells, "; "))

    return F.array_join(F.concat(F.array(head), F.transform(rows, one)), "\n")


def append_tables(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """Paragraph and table elements of documents in one order: tables follow all paragraphs."""
    both = paragraphs.withColumn("__t", F.lit(0)).unionByName(tables.withColumn("__t", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("__t", "ord")
    return both.withColumn("element_id", F.row_number().over(order) - 1).drop("__t")
