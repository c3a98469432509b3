"""What kind of document a file is: by name, by its first bytes, or by a declared type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by extension.
MEDIA_TYPES = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword"}
OCTETS = "application/octet-stream"
#: Extensions that each way of extraction accepts.
FORMATS = {"pdf": (".pdf",), "docx": (".docx", ".doc"), "detector": (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".pdf")}


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of files; works with any file system that Spark reads."""
    return spark.read.format("binaryFile").load(list(paths))


def kind_by_name(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx") | low.endswith(".doc"), "docx")


def kind_by_content(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head == "255044462D", "pdf").when(head.startswith("504B0304"), "docx")


def media_type(declared: Column, name: Column) -> Column:
    """The declared type unless it says nothing, then the type of the extension."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for extension, kind in reversed(MEDIA_TYPES.items()):
        out = F.when(low.endswith(extension), kind).otherwise(out)
    return F.when(declared.isNotNull() & (declared != OCTETS), declared).otherwise(out)


def routed(rows: DataFrame) -> DataFrame:
    """Adds kind and error: files of no known kind stay, with an error in place of a failure."""
    kind = F.coalesce(kind_by_name(F.col("path")), kind_by_content(F.col("content")) if "content" in rows.columns else F.lit(None).cast("string"))
    return rows.withColumn("kind", kind).withColumn("error", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported file: "), F.col("path"))))


def accepted(path: Column, way: str) -> Column:
    """Whether the file's name has an extension that this way of extraction (a key of FORMATS) accepts; false for null."""
    low = F.lower(path)
    out = F.lit(False)
    for extension in FORMATS[way]:
        out = out | low.endswith(extension)
    return F.coalesce(out, F.lit(False))


def ways(spark: SparkSession) -> DataFrame:
    """The ways of extraction with the extensions they accept and whether bytes without a name are taken as well."""
    return spark.createDataFrame([(way, list(found), way != "docx") for way, found in FORMATS.items()], "way string, extensions array<string>, takes_bytes boolean")
