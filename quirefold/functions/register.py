"""Names of the package's functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fuzzy


class LinesOf:
    """lines_of(text): ord and text of the non-blank lines."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        kept = (line for line in (text or "").split("\n") if line.strip())
        yield from enumerate(kept)


class HtmlBlocks:
    """html_blocks(html): ord, element_type, heading_level, text, path of its text blocks."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..sources.html import blocks_of

        for i, row in enumerate(blocks_of(html)):
            yield (i, *row)


def register(spark: SparkSession) -> None:
    """indel_ratio, partial_ratio, token_sort_ratio and near_spans as functions; lines_of and html_blocks as table
    functions that join laterally."""
    spark.udf.register("indel_ratio", fuzzy.indel_ratio)
    spark.udf.register("partial_ratio", fuzzy.indel_partial_ratio)
    spark.udf.register("token_sort_ratio", fuzzy.indel_token_sort_ratio)
    spark.udf.register("near_spans", fuzzy.near_spans)
    spark.udtf.register("lines_of", F.udtf(LinesOf, returnType="ord int, text string"))
    spark.udtf.register("html_blocks", F.udtf(HtmlBlocks, returnType="ord int, element_type string, heading_level int, text string, path string"))
