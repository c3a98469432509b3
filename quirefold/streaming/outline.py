"""Outlines that arrive in pieces: complete lines as they come, sections once they can change no more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import outline, sections

LINES = "doc_id long, line_no int, line string, closed boolean"


def completed_lines(chunks: DataFrame) -> DataFrame:
    """Lines of streamed chunks(doc_id, seq, chunk, is_end), each as soon as its line break has come.

    Per document the state holds the unfinished line, the number of lines so far, and chunks that came ahead of their
    turn (by seq). A row with is_end flushes the rest and drops the state; the last line is marked closed. An outline
    without any line sends none.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n, turn, early = state.get if state.exists else ("", 0, 0, [])
        waiting = {int(s): (c, bool(e)) for s, c, e in early}
        for batch in batches:
            for seq, chunk, end in zip(batch.seq, batch.chunk, batch.is_end, strict=True):
                if seq >= turn:
                    waiting[int(seq)] = (chunk or "", bool(end))
        out, closed = [], False
        while turn in waiting and not closed:
            chunk, closed = waiting.pop(turn)
            turn += 1
            *whole, rest = (rest + chunk).split("\n")
            out += whole
        if closed and rest:
            out.append(rest)
        rows = pd.DataFrame({"doc_id": pd.Series([key[0]] * len(out), dtype="int64"), "line_no": pd.Series(range(n, n + len(out)), dtype="int32"), "line": pd.Series(out, dtype="object"), "closed": pd.Series([closed and i == len(out) - 1 for i in range(len(out))], dtype="bool")})
        if closed:
            state.remove()
        else:
            state.update((rest, n + len(out), turn, [(s, c, e) for s, (c, e) in sorted(waiting.items())]))
        yield rows

    state = "rest string, n int, turn long, early array<struct<seq:long,chunk:string,is_end:boolean>>"
    return chunks.groupBy("doc_id").applyInPandasWithState(advance, LINES, state, "append", GroupStateTimeout.NoTimeout)


def snapshot(lines: DataFrame, elements: DataFrame, fuzzy: bool = False, flat: bool = True) -> DataFrame:
    """Sections of all lines so far: matched to elements, with parents and contents; flat gives paths in order."""
    titles = outline.match_titles(outline.number_lines(lines), elements, fuzzy)
    found = sections.contents(sections.parents(titles), elements)
    return sections.flatten(found) if flat else found


def error_sections(failures: DataFrame, id_type: str = "long") -> DataFrame:
    """failures(doc_id, error) as sections: title "Error", what went wrong as content, level 0; one for each failed
    document (the smallest message), none where error is null."""
    one = failures.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    text = F.concat(F.lit("Failed to process document: "), F.col("error"))
    return one.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.lit("Error").alias("title"), text.alias("content"), F.lit(0).alias("level"))


def deliver(lines: DataFrame, elements: DataFrame, history: str, sink: Callable[[DataFrame, int], None], fuzzy: bool = False, failures: DataFrame | None = None):
    """A streaming query that hands each section to `sink(rows, batch_id)` once, when it is finished: its successor has
    come, or its outline has ended.

    `history` is a folder for lines by batch; a batch that runs again overwrites its own part, so the sections sent with
    a batch number are the same each time. A document in failures(doc_id, error) sends its error section with the first
    of its lines and nothing else, and the others go on. Each batch reads the elements of the documents it touches.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        touched = spark.read.schema(LINES).parquet(f"{history}/batch={number}").select("doc_id").distinct()
        so_far = spark.read.schema(f"{LINES}, batch int").parquet(history).where(F.col("batch") <= number).join(touched, "doc_id", "left_semi")

        failed = None
        if failures is not None:
            known = so_far.where(F.col("batch") < number).select("doc_id").distinct()
            failed = error_sections(failures.join(touched, "doc_id", "left_semi").join(known, "doc_id", "left_anti"))
            so_far = so_far.join(failures.where("error is not null"), "doc_id", "left_anti")
        parts = elements.join(touched, "doc_id", "left_semi")

        def done(rows: DataFrame) -> DataFrame:
            return sections.finished(snapshot(rows, parts, fuzzy, flat=False), rows.where("closed"))

        sent = done(so_far.where(F.col("batch") < number)).select("doc_id", "title_idx")
        rows = done(so_far).join(sent, ["doc_id", "title_idx"], "left_anti")
        sink(rows if failed is None else rows.unionByName(failed, allowMissingColumns=True), number)

    return lines.writeStream.foreachBatch(each)
