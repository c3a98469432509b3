"""Title numbers: Chinese, Roman and dotted numbering, and how two numbers relate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal

#: Numerals and their worth.
CHINESE_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Units of numbered clauses.
CLAUSE_UNITS = "条款项目章节部编篇"
#: Alphabetic parts that are read as Roman numerals.
ROMAN_PARTS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
_NUMERALS = "".join([*CHINESE_DIGITS, *CHINESE_UNITS])
CLAUSE = rf"^第([{_NUMERALS}]+)([{CLAUSE_UNITS}])"
IN_PARENTHESES = rf"^[（(]([{_NUMERALS}]+)[）)]"
DIGITS_IN_PARENTHESES = r"^[（(](\d+)[）)]"
#: A letter run and digits, further dotted parts; may be empty unless strict.
DOTTED = r"^([a-zA-Z]*\d*(?:\.[a-zA-Z\d]+)*)"


def _worth(table: dict[str, int], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def chinese_number(text: Column, compat: bool = False) -> Column:
    """Value of Chinese numerals. compat multiplies all that was read so far by each unit, as some readers do:
    一百二十三 is then 1023 instead of 123."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        digit, unit = _worth(CHINESE_DIGITS, c), _worth(CHINESE_UNITS, c)
        if compat:
            whole = s["total"] + s["digit"]
            scaled = F.when(whole == 0, unit).otherwise(whole * unit)
            return F.when(unit.isNotNull(), F.struct(F.lit(0).cast("long").alias("total"), scaled.cast("long").alias("digit"), F.lit(0).cast("long").alias("section"))).when(
                digit.isNotNull(), F.struct(F.lit(0).cast("long").alias("total"), (whole + digit).cast("long").alias("digit"), F.lit(0).cast("long").alias("section"))
            ).otherwise(s)
        myriad = F.struct(((s["total"] + s["section"] + s["digit"]) * unit).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"), F.lit(0).cast("long").alias("section"))
        some = F.when(s["digit"] == 0, F.lit(1)).otherwise(s["digit"])
        small = F.struct(s["total"].alias("total"), F.lit(0).cast("long").alias("digit"), (s["section"] + some * unit).cast("long").alias("section"))
        plain = F.struct(s["total"].alias("total"), digit.cast("long").alias("digit"), s["section"].alias("section"))
        return F.when(unit == 10000, myriad).when(unit.isNotNull(), small).when(digit.isNotNull(), plain).otherwise(s)

    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("total", "digit", "section")])
    return F.aggregate(letters, zero, step, lambda s: s["total"] + s["section"] + s["digit"])


def roman_number(text: Column) -> Column:
    """Subtractive reading from the right; other letters count as 0."""
    letters = F.reverse(F.filter(F.split(F.upper(text), ""), lambda c: c != ""))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))

    def step(s: Column, c: Column) -> Column:
        value = F.coalesce(_worth(ROMAN, c), F.lit(0))
        return F.struct((s["sum"] + F.when(value < s["last"], -value).otherwise(value)).alias("sum"), value.alias("last"))

    return F.aggregate(letters, zero, step, lambda s: s["sum"])


def _part(part: Column) -> Column:
    """One dotted part in canonical form: number, Roman numeral as number, letters in lower case, else as it is."""
    plain = F.regexp_replace(part, r"^0+(?=\d)", "")
    letters = part.rlike("^[a-zA-Z]+$")
    return F.when(part.rlike(r"^\d+$"), plain).when(letters & F.lower(part).isin(*ROMAN_PARTS), roman_number(part).cast("string")).when(letters, F.lower(part)).otherwise(part)


def title_number(text: Column, compat: bool = False, strict: bool = False) -> Column:
    """struct(number_type, parts, is_int, level, unit) of the number at the start of a title; null for blank text.

    Patterns in order: clause (第三条), Chinese numerals in parentheses, digits in parentheses, dotted letters and
    digits. The last accepts any text, so a text without number has the part '' or its first word; strict asks for a
    digit there and then tries a Roman numeral and a single letter.
    """
    t = normal(text)
    made = lambda kind, parts, ints, level, unit=None: F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("number_type"), parts.alias("parts"), ints.alias("is_int"), level.cast("int").alias("level"), F.lit(unit).cast("string").alias("unit") if unit is None else unit.alias("unit")
    )
    one = lambda n: (F.array(n.cast("string")), F.array(F.lit(True)))
    clause = made("chinese_unit", *one(chinese_number(F.regexp_extract(t, CLAUSE, 1), compat)), F.lit(0), F.regexp_extract(t, CLAUSE, 2))
    inside = made("chinese_parenthetical", *one(chinese_number(F.regexp_extract(t, IN_PARENTHESES, 1), compat)), F.lit(1))
    digits = made("arabic_parenthetical", *one(F.regexp_replace(F.regexp_extract(t, DIGITS_IN_PARENTHESES, 1), r"^0+(?=\d)", "")), F.lit(1))
    raw = F.split(F.regexp_extract(t, DOTTED, 1), r"\.")
    parts = F.transform(raw, _part)
    ints = F.transform(parts, lambda p: p.rlike(r"^\d+$"))
    kind = F.when(F.forall(ints, lambda b: b), "arabic_decimal").otherwise("mixed_alphanumeric")
    dotted = made(kind, parts, ints, F.size(parts) - 1)
    out = F.when(t.isNull(), F.lit(None)).when(t.rlike(CLAUSE), clause).when(t.rlike(IN_PARENTHESES), inside).when(t.rlike(DIGITS_IN_PARENTHESES), digits)
    if not strict:
        return out.otherwise(dotted)
    roman = made("roman_numeral", *one(roman_number(F.regexp_extract(t, r"^([IVXLCDM]+)\.?\s", 1))), F.lit(0))
    letter = made("alphabetic", F.array(F.lower(F.substring(t, 1, 1))), F.array(F.lit(False)), F.lit(0))
    out = out.when(F.regexp_extract(t, DOTTED, 1).rlike(r"\d"), dotted)
    return out.when(t.rlike(r"^[IVXLCDM]+\.?\s"), roman).when(t.rlike(r"^[a-zA-Z]\.?\s"), letter)


def hierarchy_path(number: Column) -> Column:
    return F.coalesce(F.array_join(number["parts"], "."), F.lit(""))


def siblings(a: Column, b: Column) -> Column:
    n = F.size(a["parts"])
    parents = lambda x: F.slice(x["parts"], F.lit(1), n - 1) == F.slice(b["parts"], F.lit(1), n - 1)
    kinds = F.slice(a["is_int"], F.lit(1), n - 1) == F.slice(b["is_int"], F.lit(1), n - 1)
    alone = (a["number_type"] == b["number_type"]) & a["unit"].eqNullSafe(b["unit"])
    return (a["level"] == b["level"]) & (n == F.size(b["parts"])) & F.when(n == 1, alone).otherwise(parents(a) & kinds)


def parent_of(parent: Column, child: Column) -> Column:
    n = F.size(parent["parts"])
    return (child["level"] == parent["level"] + 1) & (F.size(child["parts"]) == n + 1) & (F.slice(child["parts"], F.lit(1), n) == parent["parts"]) & (F.slice(child["is_int"], F.lit(1), n) == parent["is_int"])


def relation(a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & siblings(a, b), "sibling").when(known & parent_of(a, b), "parent_child").when(known & parent_of(b, a), "child_parent").otherwise("unrelated")
