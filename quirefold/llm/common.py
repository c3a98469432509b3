"""Session helpers: shared storage, table loading, driver-made lookup tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where that is unset, a session on one machine (tests,
    benchmarks) gets a temporary folder, and any other the warehouse, which a cluster shares too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of at most so many rows, where the session keeps the default of 10,000.

    Batches lie in an executor's memory outside its heap, at both ends, and texts are thousands of bytes each.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirefold/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files behind a stashed table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quirefold/" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000, bytes_of: str | None = None, most: int = 32 << 20) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows and its column `bytes_of` (else its rows, counted
    as narrow) at most so many bytes in all. Larger tables are left to shuffle joins."""
    n, total = df.agg(F.count("*"), F.sum(F.expr(bytes_of or "0"))).collect()[0]
    return F.broadcast(df) if n <= rows and (total or 0) <= most else df


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table as one JSON literal: stays in the JVM, no RDD of Python objects.

    `schema` is a DDL column list; values are given in that order.
    """
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = "array<struct<" + ",".join(":".join(p.split()) for p in schema.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def utf8_bytes(text: Column) -> Column:
    """Length of the text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text modulo folds equals fold (a null id hashes as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
