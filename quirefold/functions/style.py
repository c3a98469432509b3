"""Font, colour, alignment and heading rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types and their codes in structural encodings; types not listed count as Unknown.
ELEMENT_TYPES = ("Plain Text", "Title", "Heading", "Figure", "Figure Caption", "Table", "Table Caption", "Table Footnote", "Isolate Formula", "Formula Caption", "List", "Paragraph", "Unknown", "Abandon")
TYPE_CODES = {"Plain Text": 0, "Title": 1, "Heading": 2, "Figure": 3, "Figure Caption": 4, "Table": 5, "Table Caption": 6, "List": 11, "Paragraph": 12, "Unknown": 13}
#: Classes of the layout detector, in order of their ids.
DETECTOR_CLASSES = ("Title", "Plain Text", "Abandon", "Figure", "Figure Caption", "Table", "Table Caption", "Table Footnote", "Isolate Formula", "Formula Caption")
#: Alignment codes; anything else is 0.
ALIGNMENT_CODES = {"left": 0, "center": 1, "right": 2, "justify": 3, "distribute": 4}
STYLE_BITS = ("bold", "italic", "underline", "strikethrough", "superscript", "subscript")


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def detector_type(class_id: Column) -> Column:
    return lookup(dict(enumerate(DETECTOR_CLASSES)), class_id.cast("int"), "Unknown")


def type_code(element_type: Column) -> Column:
    return lookup(TYPE_CODES, element_type, 13)


def alignment_code(alignment: Column) -> Column:
    return lookup(ALIGNMENT_CODES, F.lower(alignment), 0)


def _flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(bit)) != 0


def is_bold(name: Column, flags: Column) -> Column:
    return _flag(flags, 16) | F.coalesce(F.lower(name).rlike("bold|black|heavy"), F.lit(False))


def is_italic(name: Column, flags: Column) -> Column:
    return _flag(flags, 2) | F.coalesce(F.lower(name).rlike("italic|oblique"), F.lit(False))


def is_underlined(name: Column, flags: Column) -> Column:
    """Bit 0 counts as underline, although common PDF libraries set it for superscripts."""
    return _flag(flags, 1) | F.coalesce(F.lower(name).contains("underline"), F.lit(False))


def hex_color(value: Column) -> Column:
    """#rrggbb of an integer colour."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value.cast("long"))), 6, "0"))


def rgb_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of three shares from 0 to 1, truncated to 255 steps."""
    part = lambda c: F.lpad(F.lower(F.hex((c * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def with_hash(color: Column) -> Column:
    return F.when(color.startswith("#"), color).otherwise(F.concat(F.lit("#"), color))


def alignment(block_x1: Column, block_x2: Column, line_x1: Column, line_x2: Column) -> Column:
    """center where both margins agree to 5 points, then right, justify, left. A block without width is never justified."""
    left, right = line_x1 - block_x1, block_x2 - line_x2
    share = (line_x2 - line_x1) / F.nullif(block_x2 - block_x1, F.lit(0))
    return F.when(F.abs(left - right) <= 5, "center").when((right <= 5) & (left > 10), "right").when(share > 0.9, "justify").otherwise("left")


def style_name(size: Column, bold: Column, italic: Column) -> Column:
    """font-12pt-Bold-Italic; Unknown where there is no size, weight or slant."""
    name = F.concat_ws("-", F.when(size > 0, F.concat(F.lit("font-"), size.cast("int").cast("string"), F.lit("pt"))), F.when(bold, F.lit("Bold")), F.when(italic, F.lit("Italic")))
    return F.when(name == "", "Unknown").otherwise(name)


def pdf_heading_level(size: Column, bold: Column) -> Column:
    return F.when(size >= 18, 1).when(size >= 16, 2).when(size >= 14, 3).when(bold & (size >= 12), 4).otherwise(0)


def docx_heading_level(style: Column) -> Column:
    """`heading N` gives N, 9 at most; a name with `title` (so `subtitle` too) gives 1; else 0."""
    low = F.lower(F.coalesce(style, F.lit("")))
    number = F.regexp_extract(low, r"heading\s*(\d+)", 1)
    return F.when(number != "", F.least(number.try_cast("int"), F.lit(9))).when(low.contains("title"), 1).otherwise(0)


def style_bits(*flags: Column) -> Column:
    """Flags in the order of STYLE_BITS as one integer."""
    total = F.lit(0)
    for bit, flag in enumerate(flags):
        total = total + F.when(flag, F.lit(1 << bit)).otherwise(F.lit(0))
    return total


def promoted_type(element_type: Column, size: Column, enabled: bool = False) -> Column:
    """Plain text in more than 12 points becomes Title, where enabled."""
    return F.when((element_type == "Plain Text") & (size > 12), "Title").otherwise(element_type) if enabled else element_type


def underline_length(x1: Column, x2: Column) -> Column:
    """Underscores that a drawn line stands for: one per 8 points, at least 6."""
    return F.greatest(((x2 - x1) / 8).cast("int"), F.lit(6))


def truth(value: Column) -> Column:
    """A boolean from a boolean, a number or a word; null where it says neither."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("true", "1", "yes", "on", "1.0"), True).when(word.isin("false", "0", "no", "off", "0.0"), False)


def points(value: Column) -> Column:
    """A length in points as a number; null where it is none."""
    return F.regexp_replace(F.trim(value.cast("string")), r"(?i)\s*pt$", "").try_cast("double")


def spacing_rule(value: Column) -> Column:
    """single, multiple, exact or at_least in lower case; null for anything else."""
    low = F.lower(value)
    return F.when(low.isin("single", "multiple", "exact", "at_least"), low)


def valid_color(color: Column) -> Column:
    return color.rlike("^#[0-9A-Fa-f]{6}$")
