"""Text expressions shared by layout, outline and section operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal(text: Column) -> Column:
    """Stripped; blank text is null."""
    return F.nullif(strip(text), F.lit(""))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def text_key(text: Column) -> Column:
    """First 16 hexadecimal digits of the MD5 of the text."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def section_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(content, F.lit(""))), 256)


def ordered_text(order: Column, text: Column, separator: str = "\n") -> Column:
    """Aggregate: non-null texts of a group in order, joined."""
    kept = F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["t"]), separator)


def display_line(element_id: Column, page: Column, kind: Column, font: Column, size: Column, color: Column, italic: Column, bold: Column, underline: Column, alignment: Column, text: Column) -> Column:
    """[id:3][page:1][type:Title][SimSun 18.0pt]... and the text; pieces that are null or false are left out, as is black."""

    def piece(label: str, value: Column, where: Column) -> Column:
        return F.when(where, F.concat(F.lit(f"[{label}:"), value.cast("string"), F.lit("]"))).otherwise("")

    shown = F.round(size, 1).cast("decimal(20,1)").cast("string")
    true = F.lit("True")
    return F.concat(
        piece("id", element_id, element_id.isNotNull()),
        piece("page", page, page.isNotNull()),
        piece("type", kind, kind.isNotNull()),
        F.when(font.isNotNull() & size.isNotNull(), F.concat(F.lit("["), font, F.lit(" "), shown, F.lit("pt]"))).otherwise(""),
        piece("color", color, color.isNotNull() & (color != "#000000")),
        piece("italic", true, F.coalesce(italic, F.lit(False))),
        piece("bold", true, F.coalesce(bold, F.lit(False))),
        piece("underline", true, F.coalesce(underline, F.lit(False))),
        piece("alignment", alignment, alignment.isNotNull()),
        F.coalesce(text, F.lit("")),
    )


def outline_number(line: Column) -> Column:
    """The first word of an outline line."""
    return F.element_at(F.split(strip(line), " ", 2), 1)


def outline_title(line: Column) -> Column:
    """What follows the number, stripped; null where the line is a single word."""
    parts = F.split(strip(line), " ", 2)
    return F.when(F.size(parts) == 2, normal(F.get(parts, F.lit(1))))


def outline_level(number: Column, normalized: bool = False) -> Column:
    """Dots in the number; normalized ignores a dot at its end."""
    counted = F.rtrim(number, F.lit(".")) if normalized else number
    return F.length(counted) - F.length(F.replace(counted, F.lit("."), F.lit("")))


def own_content(element: Column, title: Column, following: Column) -> Column:
    """The part of an element's text that belongs to one of several titles in it.

    It begins a title's length after the title, or after the title without full-width parentheses where only that is
    found, and ends before the next title. Colons at its start go. Empty where the title is not found.
    """
    bare = lambda t: F.regexp_replace(t, "[（）]", "")
    begin = F.instr(element, title)
    begin = F.when(begin > 0, begin).otherwise(F.instr(element, bare(title)))
    rest = F.substr(element, begin + F.length(title))
    at = F.instr(rest, following)
    at = F.when(at > 0, at).otherwise(F.instr(rest, bare(following)))
    cut = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest)
    return F.when(F.coalesce(begin, F.lit(0)) > 0, strip(F.regexp_replace(strip(cut), "^[：:]+", ""))).otherwise("")
