"""Streams of outline pieces end like batches, whatever the cut."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators import sections
from quirefold.streaming import outline as stream

OUTLINE = "1. A\n1.1. B\n2. C"
SCHEMA = "doc_id long, seq long, chunk string, is_end boolean"


def pieces(spark, size):
    rows = [(d, i, OUTLINE[i * size : (i + 1) * size], False) for d in (1, 2) for i in range(-(-len(OUTLINE) // size))]
    rows += [(1, -(-len(OUTLINE) // size), "", True)]  # document 2 never ends
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [1, 5, 100])
def test_lines(spark, tmp_path, size):
    for i, part in enumerate(pieces(spark, size).randomSplit([0.5, 0.5], seed=size)):  # chunks may come ahead of their turn
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = stream.completed_lines(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    done = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination()
    got = {(r["doc_id"], r["line_no"]): (r["line"], r["closed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): ("1. A", False), (1, 1): ("1.1. B", False), (1, 2): ("2. C", True), (2, 0): ("1. A", False), (2, 1): ("1.1. B", False)}


def test_sections_are_delivered_once_when_finished(spark, tmp_path):
    for i in range(3):
        pieces(spark, 8).where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    elements = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(["A", "a", "B", "b", "C", "c"])], "doc_id long, ord long, text string")
    sent = []
    lines = stream.completed_lines(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    writer = stream.deliver(lines, elements, str(tmp_path / "history"), lambda rows, n: sent.extend((r["doc_id"], r["title"], r["content"]) for r in rows.collect()))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(sent) == [(1, "A", "a"), (1, "B", "b"), (1, "C", "c"), (2, "A", "a")]
    whole = spark.createDataFrame([(1, i, t) for i, t in enumerate(OUTLINE.split("\n"))], "doc_id long, line_no int, line string")
    batch = stream.snapshot(whole, elements.where("doc_id = 1"), flat=False).collect()
    assert sorted((r["title"], r["content"]) for r in batch) == [("A", "a"), ("B", "b"), ("C", "c")]
    assert sections.flatten(stream.snapshot(whole, elements, flat=False)).count() == 3


def test_a_failed_document_sends_its_error_and_the_others_go_on(spark, tmp_path):
    for i in range(3):
        pieces(spark, 8).where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    elements = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(["A", "a", "B", "b", "C", "c"])], "doc_id long, ord long, text string")
    failures = spark.createDataFrame([(2, "no text"), (1, None), (3, "never touched")], "doc_id long, error string")
    sent = []
    lines = stream.completed_lines(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    writer = stream.deliver(lines, elements, str(tmp_path / "history"), lambda rows, n: sent.extend((r["doc_id"], r["title"], r["content"]) for r in rows.collect()), failures=failures)
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(sent) == [(1, "A", "a"), (1, "B", "b"), (1, "C", "c"), (2, "Error", "Failed to process document: no text")]
