"""Hand-derived values of column functions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import fuzzy, numbering, position, register, style
from quirefold.functions import text as tx
from quirefold.functions.geometry import Box, center_inside, iou, overlap_of_smaller


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "text,correct,compat",
    [("六百一十", 610, 6010), ("一百二十三", 123, 1023), ("三千五百", 3500, 300500), ("二十三", 23, 23), ("十二", 12, 12), ("一万二千", 12000, 12000), ("零", 0, 0)],
)
def test_chinese_numbers(spark, text, correct, compat):
    assert one(spark, numbering.chinese_number(F.col("t")), t=text) == correct
    if text != "一万二千":
        assert one(spark, numbering.chinese_number(F.col("t"), compat=True), t=text) == compat


@pytest.mark.parametrize("text,value", [("IV", 4), ("ix", 9), ("XIV", 14), ("MCMXC", 1990), ("Z", 0)])
def test_roman_numbers(spark, text, value):
    assert one(spark, numbering.roman_number(F.col("t")), t=text) == value


def test_strict_numbering(spark):
    strict = lambda t: one(spark, numbering.title_number(F.col("t"), strict=True)["number_type"], t=t)
    assert strict("XIV. Close") == "roman_numeral"
    assert strict("a. item") == "alphabetic"
    assert strict("Hello world") is None
    assert strict("   ") is None


def test_ratios():
    assert fuzzy.ratio("abcd", "abxd") == 75.0
    assert fuzzy.ratio("", "") == 100.0
    assert fuzzy.partial_ratio("abc", "xx abc yy") == 100.0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100.0
    assert not fuzzy.title_matches("abcd", "abxd")
    assert fuzzy.title_matches("丁方（担保方）", "本合同丁方担保方为")
    assert not fuzzy.title_matches("", "x") and not fuzzy.title_matches("x", None)
    assert fuzzy.near_sequence("alpha betta gamma", ["alpha", "beta"], 1) == [(0, 5), (6, 11)] or fuzzy.near_sequence("alpha betta gamma", ["alpha", "beta"], 1)[0] == (0, 5)
    assert fuzzy.near_sequence("alpha", ["zzzzzzzz"], 3) == []


def test_own_content(spark):
    own = lambda e, t, n: one(spark, tx.own_content(F.col("e"), F.col("t"), F.col("n")), e=e, t=t, n=n)
    assert own("甲方：张三 乙方：李四", "甲方", "乙方") == "张三"
    assert own("甲方：张三", "甲方", "丙方") == "张三"
    assert own("张三", "甲方", "乙方") == ""


@pytest.mark.parametrize("x1,x2,expected", [(0, 100, "center"), (40, 100, "right"), (0, 93, "justify"), (0, 50, "left")])
def test_alignment(spark, x1, x2, expected):
    assert one(spark, style.alignment(F.lit(0.0), F.lit(100.0), F.col("a"), F.col("b")), a=float(x1), b=float(x2)) == expected


def test_alignment_of_block_without_width(spark):
    assert one(spark, style.alignment(F.lit(5.0), F.lit(5.0), F.col("a"), F.col("b")), a=0.0, b=30.0) in ("left", "right", "center")


def test_styles(spark):
    assert one(spark, style.style_name(F.col("s"), F.lit(True), F.lit(True)), s=12.0) == "font-12pt-Bold-Italic"
    assert one(spark, style.style_name(F.lit(None).cast("double"), F.lit(False), F.lit(False)), s=1) == "Unknown"
    assert one(spark, style.hex_color(F.col("c")), c=255) == "#0000ff"
    assert one(spark, style.docx_heading_level(F.col("s")), s="Heading 3") == 3
    assert one(spark, style.docx_heading_level(F.col("s")), s="heading 99999999999") in (9, None)
    assert one(spark, style.is_bold(F.col("n"), F.col("f")), n="Arial-Black", f=0) is True
    assert one(spark, style.is_underlined(F.lit(None).cast("string"), F.col("f")), f=1) is True


def test_geometry(spark):
    boxes = {f"{p}{c}": float(v) for p, vs in (("a", (0, 0, 10, 10)), ("b", (5, 0, 15, 10)), ("c", (20, 20, 30, 30))) for c, v in zip(("x1", "y1", "x2", "y2"), vs)}
    a, b, c = Box.of("a"), Box.of("b"), Box.of("c")
    assert one(spark, iou(a, b), **boxes) == pytest.approx(50 / 150)
    assert one(spark, overlap_of_smaller(a, b), **boxes) == 0.5
    assert one(spark, iou(a, c), **boxes) == 0.0
    assert one(spark, iou(a, b) - iou(b, a), **boxes) == 0.0
    assert one(spark, center_inside(Box(F.lit(9.0), F.lit(0.0), F.lit(11.0), F.lit(2.0)), a), **boxes) is False  # the right edge is outside


def test_display_line(spark):
    line = tx.display_line(F.lit(3), F.lit(1), F.lit("Title"), F.lit("SimSun"), F.lit(18.0), F.lit("#000000"), F.lit(False), F.lit(True), F.lit(False), F.lit("left"), F.lit("第一章"))
    assert one(spark, line, x=1) == "[id:3][page:1][type:Title][SimSun 18.0pt][bold:True][alignment:left]第一章"
    bare = tx.display_line(*[F.lit(None)] * 4, F.lit(None).cast("double"), *[F.lit(None).cast("string")] * 1, *[F.lit(None).cast("boolean")] * 3, F.lit(None).cast("string"), F.lit("x"))
    assert one(spark, bare, x=1) == "x"


def test_outline_levels(spark):
    level = lambda n, **k: one(spark, tx.outline_level(F.col("n"), **k), n=n)
    assert [level(n) for n in ("1.", "1.1", "1.1.", "1.1.1", "1")] == [1, 1, 2, 2, 0]
    assert [level(n, normalized=True) for n in ("1.", "1.1", "1.1.")] == [0, 1, 1]


def test_tolerant_values(spark):
    assert [one(spark, style.truth(F.col("v")), v=v) for v in ("Yes", "0", "maybe", "true")] == [True, False, None, True]
    assert [one(spark, style.points(F.col("v")), v=v) for v in ("12pt", " 1.5 ", "x")] == [12.0, 1.5, None]
    assert [one(spark, style.spacing_rule(F.col("v")), v=v) for v in ("At_Least", "other")] == ["at_least", None]
    assert [one(spark, style.valid_color(style.with_hash(F.col("v"))), v=v) for v in ("ff00AA", "#12345")] == [True, False]


def test_positions(spark):
    place = position.position("pdf", (F.lit(3), F.lit(9)), page_number=F.col("p"))
    row = one(spark, place, p=0)
    assert row["document_type"] == "pdf" and row["pdf_position"]["page_number"] == 0 and row["html_position"] is None and row["text_position"]["end"] == 9
    assert one(spark, position.pdf_page(place), p=0) == 1
    with pytest.raises(ValueError):
        position.position("html", page_number=F.lit(1))


def test_names_for_sql(spark):
    register.register(spark)
    assert spark.sql("SELECT indel_ratio('abcd', 'abxd') AS r").collect()[0]["r"] == 75.0
    rows = spark.sql("SELECT d.id, l.* FROM (SELECT 7 AS id, 'a\n \nb' AS t) d, LATERAL lines_of(d.t) l ORDER BY ord").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "a"), (7, 1, "b")]
    assert spark.sql("SELECT text FROM html_blocks('<p>x</p>')").collect()[0]["text"] == "x"


def test_windows_are_compared_together_as_one_by_one():
    import random

    r = random.Random(3)
    for letters in ("ab ", "abcdefgh ", "丁方（）cd"):
        longer = ["".join(r.choice(letters) for _ in range(r.randint(1, 90))) for _ in range(40)]
        for n in (1, 7, 64, 70):
            title = "".join(r.choice(letters) for _ in range(n))
            fits = [b for b in longer if len(b) >= n]
            slow = [max(fuzzy.ratio(title, b[max(0, end - n) : min(end, len(b))]) for end in range(1, len(b) + n)) for b in fits]
            assert list(fuzzy.partial_ratios([title], fits)) == slow == list(fuzzy.partial_ratios([title] * len(fits), fits))
        title = longer[0][:12]
        assert fuzzy.first_match(title, longer, 1) == next((i for i in range(1, 40) if fuzzy.title_matches(title, longer[i])), None)


def test_a_long_text_is_searched_without_a_call_for_each_window(monkeypatch):
    calls = []
    plain = fuzzy.lcs_length
    monkeypatch.setattr(fuzzy, "lcs_length", lambda a, b: calls.append(1) or plain(a, b))
    assert fuzzy.first_match("a heading of this text", ["lorem ipsum dolor sit amet " * 400, "so: a heding of this text"]) == 1
    assert len(calls) < 10
