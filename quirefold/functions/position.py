"""Positions in documents of any kind: the kind, one set variant, the character range, free metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of the variants by kind of document; PDF pages count from 0.
VARIANTS = {
    "text": "struct<start:int,end:int>",
    "pdf": "struct<page_number:int,bounding_box:struct<x1:double,y1:double,x2:double,y2:double>,text_start:int,text_end:int>",
    "docx": "struct<paragraph_index:int,character_start:int,character_end:int,section_index:int>",
    "html": "struct<element_selector:string,text_start:int,text_end:int>",
}
FIELDS = {"text": ("start", "end"), "pdf": ("page_number", "bounding_box", "text_start", "text_end"), "docx": ("paragraph_index", "character_start", "character_end", "section_index"), "html": ("element_selector", "text_start", "text_end")}


def position(kind: str, characters: tuple[Column, Column] | None = None, metadata: Column | None = None, **fields: Column) -> Column:
    """The position struct of a document kind: document_type, a column for each variant, metadata.

    Only the kind's own variant is set, and the text variant where `characters` (start, end) are given. Fields not given
    are null; unknown kinds and fields are errors.
    """
    unknown = set(fields) - set(FIELDS[kind])
    if unknown:
        raise ValueError(f"no such field of a {kind} position: {', '.join(sorted(unknown))}")
    given = {kind: fields} | ({"text": dict(zip(FIELDS["text"], characters, strict=True))} if characters else {})
    variant = lambda k: F.struct(*[given[k].get(n, F.lit(None)).alias(n) for n in FIELDS[k]]).cast(VARIANTS[k]) if k in given else F.lit(None).cast(VARIANTS[k])
    free = F.lit(None) if metadata is None else metadata
    return F.struct(F.lit(kind).alias("document_type"), *[variant(k).alias(f"{k}_position") for k in VARIANTS], free.cast("map<string,string>").alias("metadata"))


def pdf_page(place: Column) -> Column:
    """Page of a PDF position counted from 1."""
    return place["pdf_position"]["page_number"] + 1
