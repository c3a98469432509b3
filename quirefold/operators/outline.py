"""Outlines: parsing numbered lines, a rule that makes one, and matching titles to elements in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.fuzzy import first_match


def parse_outline(outlines: DataFrame, normalized: bool = False) -> DataFrame:
    """Lines `number title` of outlines(doc_id, outline) as doc_id, title_idx, level, number, title; other lines go.

    level counts the dots of the number (normalized: without one at its end); number comes without dots at its ends.
    """
    lines = outlines.select("doc_id", F.posexplode(F.split("outline", "\n")).alias("line_no", "line"))
    return number_lines(lines, normalized)


def number_lines(lines: DataFrame, normalized: bool = False) -> DataFrame:
    """The same from lines(doc_id, line_no, line)."""
    number, title = tx.outline_number(F.col("line")), tx.outline_title(F.col("line"))
    found = lines.select("doc_id", "line_no", tx.outline_level(number, normalized).alias("level"), F.regexp_replace(number, r"^\.+|\.+$", "").alias("number"), title.alias("title")).where("title is not null")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return found.withColumn("title_idx", F.row_number().over(order) - 1).select("doc_id", "title_idx", "level", "number", "title")


def rule_number(title_idx: Column) -> Column:
    """1., 1.1, 1.1.1, 2., ... for titles 0, 1, 2, 3, ..."""
    branch, deep = (F.floor(title_idx / 3) + 1).cast("string"), title_idx % 3
    return F.concat(branch, F.when(deep == 0, F.lit(".")).when(deep == 1, F.lit(".1")).otherwise(F.lit(".1.1")))


def short_lines_as_titles(elements: DataFrame, longest: int = 40) -> DataFrame:
    """Outline by rule, in place of a language model: an element of at most so many characters is a title.

    Numbers run 1., 1.1, 1.1.1 by the title's position, three to a branch; element_ord is the element itself.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    titles = elements.where(F.length("text") <= longest).withColumn("title_idx", (F.row_number().over(order) - 1).cast("int"))
    number = rule_number(F.col("title_idx"))
    return titles.select("doc_id", "title_idx", number.alias("token"), tx.outline_level(number).alias("level"), F.rtrim(number, F.lit(".")).alias("number"), F.col("text").alias("title"), F.col("ord").cast("long").alias("element_ord"))


def match_titles(titles: DataFrame, elements: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds element_ord to titles: the first element, not before the last match, whose text holds the title.

    Unmatched titles get null and do not move the search on. The search is sequential within a document, so a document's
    titles in order and its elements in order are one row, and documents are independent. fuzzy False asks for exact
    containment, which needs no Python.
    """
    titles = titles.drop("element_ord")
    t = titles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("title_idx", F.struct(*titles.columns).alias("row")))).alias("__titles"))
    e = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "text"))).alias("__elements"))
    both = t.join(e, "doc_id", "left").withColumn("__elements", F.coalesce("__elements", F.array().cast("array<struct<ord:bigint,text:string>>")))
    found = both.withColumn("__hits", _near_hits(F.col("__titles.row.title"), F.col("__elements.text")) if fuzzy else _exact_hits())
    rows = found.select(F.explode(F.zip_with("__titles", "__hits", lambda one, hit: F.struct(one["row"].alias("row"), F.get("__elements", hit)["ord"].alias("element_ord")))).alias("r"))
    return rows.select("r.row.*", "r.element_ord")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _near_hits(titles: pa.Array, texts: pa.Array) -> pa.Array:
    """Of each document, the place of the element of each title; documents become Python objects one by one."""
    out = []
    for title_list, text_list in zip(titles, texts, strict=True):
        found, at, elements = [], 0, text_list.as_py()
        normal = [" ".join((x or "").split()) for x in elements]
        for title in title_list.as_py():
            hit = first_match(title, elements, at, normal)
            found.append(hit)
            at = at if hit is None else hit
        out.append(pa.array(found, pa.int32()))
    return pa.array(out, pa.list_(pa.int32()))


def _exact_hits() -> Column:
    """The search by containment as a fold over __titles and __elements."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, one: Column) -> Column:
        title = one["row"]["title"]
        here = F.slice("__elements", state["at"] + 1, F.size("__elements"))
        holds = F.transform(here, lambda x: F.coalesce((title != "") & x["text"].contains(title), F.lit(False)))
        hit = F.array_position(holds, True).cast("int")  # 0: none
        return F.struct(F.when(hit > 0, state["at"] + hit - 1).otherwise(state["at"]).alias("at"), F.concat(state["hits"], F.array(F.when(hit > 0, state["at"] + hit - 1))).alias("hits"))

    return F.aggregate("__titles", start, step, lambda s: s["hits"])


def relate(numbers: DataFrame, relation: Column) -> DataFrame:
    """Pairs of a document's numbered titles (a before b) with their relation; `relation` reads a_number and b_number."""
    a = numbers.select("doc_id", F.col("title_idx").alias("a_idx"), F.col("number").alias("a_number"))
    b = numbers.select("doc_id", F.col("title_idx").alias("b_idx"), F.col("number").alias("b_number"))
    return a.join(b, "doc_id").where("a_idx < b_idx").select("doc_id", "a_idx", "b_idx", relation.alias("relation"))
