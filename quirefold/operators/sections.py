"""Sections as adjacency rows: parents, content between titles, flattened paths, heading trees, snapshots."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

def parents(titles: DataFrame, prune: bool = False, max_level: int | None = None) -> DataFrame:
    """Adds parent_idx: the last earlier title one level up, failing that two up, and so on; null at the root.

    Titles of an ended branch still count unless prune, as `2.1.1` after `1.1` and `2.` then hangs below `1.1`. With
    prune the parent is the last earlier title of any lower level. max_level is the deepest level there is; it is read
    from the titles where the caller does not know it.
    """
    max_level = (titles.agg(F.max("level")).collect()[0][0] or 0) if max_level is None else max_level
    order = Window.partitionBy("doc_id").orderBy("title_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("title_idx"))).over(order) for k in range(max_level)]
    if prune:
        up = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > k, last[k]) for k in range(max_level)])
    else:
        up = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("level") > k, last[k]) for k in reversed(range(max_level))])
    return titles.withColumn("parent_idx", up)


def of_marked(elements: DataFrame, is_title: Column) -> DataFrame:
    """Sections where titles are marked on the elements themselves: doc_id, title_idx, title, content, section_hash.

    One shuffle by document serves the window and the aggregation; text before the first title belongs to no section.
    """
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = elements.select("doc_id", "ord", "text", F.coalesce(is_title, F.lit(False)).alias("__title"))
    owned = marked.withColumn("title_idx", F.sum(F.col("__title").cast("int")).over(order) - 1).where("title_idx >= 0")
    body = tx.ordered_text(F.col("ord"), F.when(~F.col("__title"), tx.normal(F.col("text"))))
    out = owned.groupBy("doc_id", "title_idx").agg(F.max(F.when(F.col("__title"), F.col("text"))).alias("title"), body.alias("content"))
    return out.withColumn("section_hash", tx.section_hash(F.col("title"), F.col("content")))


def contents(titles: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds content and section_hash to matched titles (element_ord): the texts strictly between a title's element and the
    next matched title's, without elements that are titles themselves; '' for unmatched titles."""
    # Titles and elements in one sequence: one shuffle by document, no join.
    info = F.struct(*titles.columns)
    t = titles.where("element_ord is not null").select("doc_id", F.col("element_ord").cast("long").alias("ord"), F.col("title_idx").alias("owner"), info.alias("info"), F.lit(None).cast("string").alias("text"))
    e = elements.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit(None).cast(titles.schema["title_idx"].dataType).alias("owner"), F.lit(None).cast(t.schema["info"].dataType).alias("info"), "text")
    order = Window.partitionBy("doc_id").orderBy("ord", F.col("owner").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    line = t.unionByName(e).withColumn("at", F.last(F.when(F.col("owner").isNotNull(), F.col("ord")), ignorenulls=True).over(order)).withColumn("owner", F.last("owner", ignorenulls=True).over(order))
    body = tx.ordered_text(F.col("ord"), F.when(F.col("info").isNull() & (F.col("ord") != F.col("at")), tx.normal(F.col("text"))))
    matched = line.where("owner is not null").groupBy("doc_id", "owner").agg(F.first("info", ignorenulls=True).alias("info"), body.alias("content")).select("info.*", "content")
    out = matched.unionByName(titles.where("element_ord is null").withColumn("content", F.lit("")))
    return out.withColumn("section_hash", tx.section_hash(F.col("title"), F.col("content")))


def shared_contents(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Puts before each section's content what its own element says after the title, up to the next title if that lies in
    the same element."""
    order = Window.partitionBy("doc_id").orderBy("title_idx")
    following = F.when(F.lead("element_ord").over(order) == F.col("element_ord"), F.lead("title").over(order))
    e = elements.select("doc_id", F.col("ord").alias("element_ord"), F.col("text").alias("__text"))
    s = sections.withColumn("__next", following).join(e, ["doc_id", "element_ord"], "left")
    own = F.coalesce(tx.own_content(F.col("__text"), F.col("title"), F.coalesce("__next", F.lit("\x00"))), F.lit(""))
    return s.withColumn("content", F.concat_ws("\n", F.nullif(own, F.lit("")), F.nullif(F.col("content"), F.lit("")))).drop("__next", "__text")


_PLACES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.LongType())]))


@F.pandas_udf(_PLACES)
def _paths(outlines: pd.Series, separators: pd.Series) -> pd.Series:
    """Of each outline, its titles in order: path and place in depth-first order."""
    out = []
    for outline, separator in zip(outlines, separators, strict=True):
        known: dict[int, tuple[str | None, tuple]] = {}
        for node in outline:
            above, key = known.get(node["parent_idx"], (None, ()))
            path = node["title"] if above is None else f"{above}{separator}{node['title']}"
            known[node["title_idx"]] = (path, (*key, node["title_idx"]))
        rank = {k: i for i, k in enumerate(sorted(known, key=lambda k: known[k][1]))}
        out.append([{"path": path, "place": rank[i]} for i, (path, _) in known.items()])
    return pd.Series(out)


def paths(sections: DataFrame, separator: str = "-") -> DataFrame:
    """Adds path, the titles from the root down, and place, the section's number in depth-first order.

    A parent comes before its children, so one pass over a document's titles builds all paths. Only titles and their
    parents go through Python, a document a row; contents stay where they are and meet the result by document.
    """
    node = F.struct("title_idx", "parent_idx", "title")
    outlines = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(node)).alias("__nodes"))
    found = outlines.select(F.col("doc_id").alias("__doc"), F.col("__nodes.title_idx").alias("__at"), _paths("__nodes", F.lit(separator)).alias("__found"))
    mine = F.get("__found", (F.array_position("__at", F.col("title_idx")) - 1).cast("int"))
    joined = sections.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")))
    return joined.select(*sections.columns, mine["path"].alias("path"), mine["place"].alias("place"))


def flatten(sections: DataFrame, separator: str = "-") -> DataFrame:
    """Flat sections in depth-first order: doc_id, sec_idx, title (the path), content, level; empty ones go."""
    whole = paths(sections.select("doc_id", "title_idx", "parent_idx", "title", "content", "level"), separator).where("title <> '' or content <> ''")
    order = Window.partitionBy("doc_id").orderBy("place")
    return whole.select("doc_id", (F.row_number().over(order) - 1).alias("sec_idx"), F.col("path").alias("title"), "content", "level")


def heading_tree(elements: DataFrame) -> DataFrame:
    """Sections from heading levels (0: text): each heading opens a section that holds the text up to the next heading;
    its parent is the last earlier heading of a lower level. Text before the first heading is section -1.

    The parent search keeps a stack per document, to which only the numbers and levels of its headings go, a document a
    row; sections and parents meet in that row, so one shuffle by document serves all steps.
    """
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    owned = elements.withColumn("sec_idx", F.coalesce(F.last(F.when(F.col("heading_level") > 0, F.col("ord")), ignorenulls=True).over(order), F.lit(-1)).cast("long"))
    text = tx.ordered_text(F.col("ord"), F.when(F.col("heading_level") == 0, tx.normal(F.col("text"))))
    title = F.max(F.when(F.col("heading_level") > 0, F.col("text")))
    bodies = owned.groupBy("doc_id", "sec_idx").agg(title.alias("title"), F.max("heading_level").alias("level"), text.alias("content"))
    whole = bodies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "title", "level", "content"))).alias("__s"))
    found = whole.withColumn("__up", _stack_parents("__s.sec_idx", F.col("__s.level").cast("array<int>")))
    rows = found.select("doc_id", F.explode(F.zip_with("__s", "__up", lambda s, up: F.struct(s.alias("s"), up.alias("up")))).alias("r"))
    # Rows without a document's id have no parents: they need not be of one document.
    return rows.select("doc_id", "r.s.*", F.when(F.col("doc_id").isNotNull(), F.col("r.up")).alias("parent_idx"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _stack_parents(numbers: pa.Array, levels: pa.Array) -> pa.Array:
    """Of each document's sections in order, the last earlier heading of a lower level; none for section -1."""
    out = []
    for section_numbers, section_levels in zip(numbers, levels, strict=True):
        stack: list[tuple[int, int]] = []
        up = []
        for idx, level in zip(section_numbers.as_py(), section_levels.as_py(), strict=True):
            while idx >= 0 and stack and stack[-1][1] >= level:
                stack.pop()
            up.append(stack[-1][0] if stack and idx >= 0 else None)
            if idx >= 0:
                stack.append((idx, level))
        out.append(pa.array(up, pa.int64()))
    return pa.array(out, pa.list_(pa.int64()))


def latest(snapshots: DataFrame) -> DataFrame:
    """Rows of each document's last snapshot (snapshot number), where a stream has sent several."""
    last = snapshots.groupBy("doc_id").agg(F.max("snapshot").alias("snapshot"))
    return snapshots.join(last, ["doc_id", "snapshot"], "left_semi").drop("snapshot")


def finished(sections: DataFrame, closed: DataFrame) -> DataFrame:
    """Sections that can change no more: those with a successor, and all of documents in closed(doc_id)."""
    order = Window.partitionBy("doc_id").orderBy("title_idx")
    done = closed.select("doc_id").distinct().withColumn("__done", F.lit(True))
    return sections.withColumn("__next", F.lead("title_idx").over(order)).join(done, "doc_id", "left").where("__next is not null or __done").drop("__next", "__done")
