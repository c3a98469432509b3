"""Operators on hand-made rows."""

import contextlib
import io
import sys
import types
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.operators import elements, encode, merge, outline, sections, spatial, tables
from quirefold.sources import docx, html, lines, pdf, routing, spans

BOX = "doc_id long, page_number int, element_id long, x1 double, y1 double, x2 double, y2 double"


def test_suppressed_boxes_do_not_suppress(spark):
    rows = [(0, 1, 0, 0.0, 0.0, 100.0, 100.0), (0, 1, 1, 0.0, 0.0, 100.0, 60.0), (0, 1, 2, 0.0, 50.0, 20.0, 62.0), (0, 2, 3, 0.0, 0.0, 5.0, 5.0), (0, 2, 4, None, None, None, None)]
    kept = {r["element_id"] for r in spatial.suppress_overlaps(spark.createDataFrame(rows, BOX)).collect()}
    assert kept == {0, 3, 4}
    chain = [(0, 1, 0, 0.0, 0.0, 100.0, 10.0), (0, 1, 1, 0.0, 0.5, 99.0, 10.5), (0, 1, 2, 0.0, 1.0, 98.0, 11.0)]
    once = spatial.suppress_overlaps(spark.createDataFrame(chain, BOX))
    assert {r["element_id"] for r in once.collect()} == {0, 2}  # 1 falls to 0, and so cannot suppress 2
    assert {r["element_id"] for r in spatial.suppress_overlaps(once).collect()} == {0, 2}


def test_lines_keep_their_anchor(spark):
    rows = [(0, 1, i, float(i), y, i + 1.0, y + 1) for i, y in enumerate([10.0, 10.4, 10.6, 11.2])]
    got = {r["element_id"]: (r["line"], r["pos"]) for r in merge.group_lines(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (2, 0)}


def test_fragments_join(spark):
    schema = BOX + ", element_type string, confidence double, text string, font_name string, font_size double, bold boolean, italic boolean"
    rows = [
        (0, 1, 1, 0.0, 0.0, 30.0, 10.0, "Plain Text", 1.0, "exam-", "F", 10.0, False, False),
        (0, 1, 2, 31.0, 0.0, 50.0, 10.0, "Plain Text", 0.9, "ple", "F", 10.0, False, False),
        (0, 1, 3, 0.0, 400.0, 30.0, 410.0, "Plain Text", 1.0, "Far.", "F", 10.0, False, False),
    ]
    got = {r["element_id"]: r for r in merge.merge_fragments(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3} and got[1]["text"] == "example" and got[1]["x2"] == 50.0 and got[1]["confidence"] == 0.9 and got[1]["n_merged"] == 2
    assert merge.joined_text(["foo", "bar"]) == "foo bar"
    assert not merge.continues("Ends.", "Capital")
    assert merge.continues("goes on", "and on")


def test_parents_keep_ended_branches(spark):
    titles = outline.parse_outline(spark.createDataFrame([(0, "1. A\n1.1. B\n2. C\n2.1.1. D\nnoise")], "doc_id long, outline string"))
    rows = {r["title"]: (r["level"], r["parent_idx"]) for r in sections.parents(titles).collect()}
    assert rows == {"A": (1, None), "B": (2, 0), "C": (1, None), "D": (3, 1)}
    pruned = {r["title"]: r["parent_idx"] for r in sections.parents(titles, prune=True).collect()}
    assert pruned["D"] == 2
    flat = sections.flatten(sections.parents(titles).withColumn("content", F.lit(""))).orderBy("sec_idx").collect()
    assert [r["title"] for r in flat] == ["A", "A-B", "A-B-D", "C"]


def test_titles_match_in_order(spark):
    titles = spark.createDataFrame([(0, 0, "Scope"), (0, 1, "absent title here"), (0, 2, "Terms")], "doc_id long, title_idx int, title string")
    rows = spark.createDataFrame([(0, 0, "Terms come later"), (0, 1, "1. Scope"), (0, 2, "zzz"), (0, 3, "2. Terms")], "doc_id long, ord int, text string")
    got = {r["title_idx"]: r["element_ord"] for r in outline.match_titles(titles, rows, fuzzy=False).collect()}
    assert got == {0: 1, 1: None, 2: 3}


def test_sections_cover_the_elements(spark):
    titles = spark.createDataFrame([(0, 0, "T", 1), (0, 1, "U", None), (0, 2, "V", 3)], "doc_id long, title_idx int, title string, element_ord long")
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(["before", "T", "a", "V", "b", " "])], "doc_id long, ord long, text string")
    got = {r["title"]: r["content"] for r in sections.contents(titles, rows).collect()}
    assert got == {"T": "a", "U": "", "V": "b"}


def test_heading_tree(spark):
    rows = spark.createDataFrame([(0, 0, "pre", 0), (0, 1, "A", 1), (0, 2, "x", 0), (0, 3, "B", 2), (0, 4, "C", 1), (0, 5, "y", 0)], "doc_id long, ord long, text string, heading_level int")
    got = {r["sec_idx"]: (r["title"], r["content"], r["parent_idx"]) for r in sections.heading_tree(rows).collect()}
    assert got == {-1: (None, "pre", None), 1: ("A", "x", None), 3: ("B", "", 1), 4: ("C", "y", None)}


def test_tables(spark):
    cells = spark.createDataFrame([(0, 1, 0, r, c, t) for r, c, t in ((0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d"))], "doc_id long, page_number int, table_id int, row int, col int, text string")
    row = tables.rows_of_tables(cells).select(tables.markdown(F.col("rows")).alias("m"), tables.record_text(F.col("rows"), F.col("n_cols")).alias("r")).collect()[0]
    assert row["m"] == "| a | b |\n| --- | --- |\n| c | d |"
    assert row["r"] == "Table with 2 rows and 2 columns\nRow 1: Cell[1,1]: a; Cell[1,2]: b\nRow 2: Cell[2,1]: c; Cell[2,2]: d"


def test_distance_total(spark):
    assert sum(encode.WEIGHTS.values()) + encode.LENGTH_WEIGHT == pytest.approx(7.0)
    schema = BOX + ", element_type string, text string, font_size double, bold boolean, alignment string"
    rows = [(0, 1, 1, 0.0, 0.0, 10.0, 10.0, "Title", "1. A", 18.0, True, "left"), (0, 1, 2, 0.0, 20.0, 10.0, 30.0, "Title", "2. B", 18.0, True, "left"), (0, 1, 3, 5.0, 90.0, 60.0, 99.0, "Table", "longer text", 9.0, False, "right")]
    codes = encode.encode(spark.createDataFrame(rows, schema))
    near = encode.similar(codes, threshold=1.0, k=1).collect()
    assert {(r["element_id"], r["other_id"]) for r in near if r["element_id"] < 3} == {(1, 2), (2, 1)}
    assert {r["cluster"] for r in encode.clusters(codes).collect() if 1 in r["element_ids"]} == {r["cluster"] for r in encode.clusters(codes).collect() if 2 in r["element_ids"]}


def test_reading_order_is_a_permutation(spark):
    rows = [(0, 1, i, float(i % 3), float(9 - i), 5.0, 20.0) for i in range(9)]
    got = elements.reading_order(spark.createDataFrame(rows, BOX))
    assert sorted(r["ord"] for r in got.collect()) == list(range(9))
    gap = spark.createDataFrame([*rows, (0, 1, 9, None, None, None, None)], BOX)
    assert [r["element_id"] for r in elements.reading_order(gap).orderBy("ord").collect()] == list(range(10))


def test_rejects(spark):
    good, bad = elements.valid_and_rejected(spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 1.0, 1.0), (0, 1, 1, 5.0, 0.0, 1.0, 1.0), (0, 1, 2, None, None, None, None)], BOX).withColumn("confidence", F.lit(0.5)))
    assert (good.count(), bad.count()) == (2, 1)


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, pr="": f'<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>{t}</w:t></w:r></w:p>'
    body = p("Intro", '<w:pStyle w:val="H1"/><w:keepNext/><w:spacing w:before="240"/><w:ind w:left="720" w:hanging="360"/><w:jc w:val="center"/>') + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p("Text") + p("  ")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    files = spark.createDataFrame([("a.docx", bytearray(_docx())), ("b.docx", bytearray(b"nonsense"))], "path string, content binary")
    rows = docx.docx_elements(files).orderBy("path", "ord").collect()
    good = [r for r in rows if r["path"] == "a.docx"]
    assert [(r["element_type"], r["text"], r["heading_level"]) for r in good] == [("Paragraph", "Intro", 1), ("Paragraph", "Text", 0), ("Table", "a\tb", 0)]
    assert good[0]["alignment"] == "center" and good[0]["font_size"] == 14.0 and good[0]["bold"]
    assert (good[0]["left_indent"], good[0]["first_line_indent"], good[0]["space_before"], good[0]["space_after"], good[0]["keep_with_next"]) == (36.0, -18.0, 12.0, None, True)
    assert good[1]["left_indent"] is None and good[2]["left_indent"] is None
    assert [r["error"] is not None for r in rows if r["path"] == "b.docx"] == [True]
    assert {r["path"]: r["text"] for r in docx.docx_text(files).collect()} == {"a.docx": "Intro\nText", "b.docx": ""}
    assert [(r["text"], r["is_heading"], r["level"]) for r in docx.docx_structure(files).orderBy("ord").collect()] == [("Intro", True, 1), ("Text", False, None)]


def test_html(spark):
    pages = spark.createDataFrame([(1, "<title>T</title><h2>Head</h2><p>a <b>b</b><br>c</p><script>x</script><ul><li>i</li></ul>"), (2, None)], "page_id long, html string")
    got = [(r["element_type"], r["heading_level"], r["text"]) for r in html.html_blocks(pages).orderBy("ord").collect()]
    assert got == [("Title", 1, "T"), ("Heading", 2, "Head"), ("Paragraph", 0, "a b"), ("Paragraph", 0, "c"), ("List", 0, "i")]


def test_lines_and_routing(spark):
    docs = spark.createDataFrame([(1, "ab\n\n c \nd"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["ord"], r["text"], r["char_start"], r["char_end"], r["y1"]) for r in lines.line_elements(docs).orderBy("ord").collect()]
    assert got == [(1, 0, "ab", 0, 2, 0.0), (1, 1, " c ", 3, 6, 40.0), (1, 2, "d", 7, 8, 60.0)]
    files = spark.createDataFrame([("a.PDF",), ("b.txt",)], "path string")
    assert {r["path"]: (r["kind"], r["error"] is None) for r in routing.routed(files).collect()} == {"a.PDF": ("pdf", True), "b.txt": (None, False)}


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(7, 1, 0, 0.0, 0.0, 1.0, 1.0)], BOX).withColumns({"element_type": F.lit("Title"), "confidence": F.lit(0.5), "text": F.lit(" x ")})
    spans.save_results(rows, str(tmp_path / "r"))
    got = spans.saved_results(spark, str(tmp_path / "r")).collect()
    assert [(r["element_id"], r["element_type"], r["text"], r["x2"]) for r in got] == [(0, "Title", "x", 1.0)]


def test_provider_makes_its_instance_where_it_runs(spark):
    class Upper:
        schema = "text string"

        def rows(self, batches):
            for batch in batches:
                yield batch.assign(text=batch.text.str.upper())[["text"]]

    assert [r["text"] for r in spans.provide(spark.createDataFrame([("a",)], "text string"), Upper).collect()] == ["A"]


def test_titles_in_one_element_share_its_text(spark):
    titles = spark.createDataFrame([(0, 0, "甲方", 0), (0, 1, "乙方", 0), (0, 2, "丙方", 2)], "doc_id long, title_idx int, title string, element_ord long")
    rows = spark.createDataFrame([(0, 0, "甲方：张三 乙方：李四"), (0, 1, "next line"), (0, 2, "丙方")], "doc_id long, ord long, text string")
    got = {r["title"]: r["content"] for r in sections.shared_contents(sections.contents(titles, rows), rows).collect()}
    assert got == {"甲方": "张三", "乙方": "李四\nnext line", "丙方": ""}


def test_snapshots_and_finished(spark):
    rows = spark.createDataFrame([(1, 1, 0, "A"), (1, 2, 0, "A"), (1, 2, 1, "B"), (2, 1, 0, "C")], "doc_id long, snapshot int, title_idx int, title string")
    last = sections.latest(rows)
    assert sorted(r["title"] for r in last.collect()) == ["A", "B", "C"]
    assert sorted(r["title"] for r in sections.finished(last, rows.where("doc_id = 2")).collect()) == ["A", "C"]


def test_tables_of_elements_and_underlines(spark):
    els = spark.createDataFrame([(0, 1, 5, 0.0, 0.0, 100.0, 100.0), (0, 1, 6, 0.0, 0.0, 5.0, 5.0)], BOX)
    tabs = spark.createDataFrame([(0, 1, 1, 10.0, 10.0, 20.0, 20.0), (0, 1, 2, 30.0, 30.0, 40.0, 40.0)], BOX.replace("element_id", "table_id"))
    assert {r["element_id"]: r["table_id"] for r in spatial.table_of_elements(els, tabs).collect()} == {5: 2, 6: None}
    lines_ = spark.createDataFrame([(0, 1, 0, 0.0, 9.0, 90.0, 9.5), (0, 1, 1, 0.0, 60.0, 9.0, 60.0)], BOX.replace("element_id", "drawing_id"))
    got = [(r["element_id"], r["d_drawing_id"], r["underscores"], r["is_horizontal"]) for r in spatial.nearby_underlines(els, lines_).collect()]
    assert sorted(got) == [(5, 0, 11, True), (6, 0, 11, True)]


def test_parents_at_any_level(spark):
    """Each title one level below the one before hangs on it, however deep; a gap hangs on the nearest level above."""
    levels = [*range(25), 3, 40, 41]
    rows = spark.createDataFrame([(1, i, k, f"t{i}") for i, k in enumerate(levels)], "doc_id long, title_idx int, level int, title string")
    got = {r["title_idx"]: r["parent_idx"] for r in sections.parents(rows).collect()}
    assert got == {0: None, **{i: i - 1 for i in range(1, 25)}, 25: 2, 26: 24, 27: 26}
    found = {r["title_idx"]: (r["path"], r["place"]) for r in sections.paths(sections.parents(rows)).collect()}
    assert found[3] == ("t0-t1-t2-t3", 3) and found[25] == ("t0-t1-t2-t25", 27) and found[27][0].endswith("t24-t26-t27")


def test_pages_without_an_id_stay(spark):
    from quirefold.sources.html import html_blocks

    pages = spark.createDataFrame([(None, "<p>a</p>"), (2**60 + 1, "<h1>b</h1>"), (3, None)], "page_id long, html string")
    assert sorted([(r["page_id"], r["text"]) for r in html_blocks(pages).collect()], key=str) == [(2**60 + 1, "b"), (None, "a")]


def test_levels_by_number_or_font_size(spark):
    rows = [(1, 1, 0, "Title", "1.2. A", 20.0), (1, 1, 1, "Title", " ", 18.0), (1, 1, 2, "Heading", " ", 16.0), (1, 1, 3, "Title", " ", 14.5), (1, 1, 4, "Title", " ", None), (1, 1, 5, "Plain Text", " ", 16.0), (1, 1, 6, "Title", "", 16.0), (1, 1, 7, "Title", None, 16.0)]
    schema = "doc_id long, page_number int, element_id long, element_type string, text string, font_size double"
    made = spark.createDataFrame(rows, schema).selectExpr("*", "'left' alignment", "0D x1", "double(element_id * 20) y1", "50D x2", "double(element_id * 20 + 10) y2")
    got = [(r["hierarchy_level"], r["hierarchy_path"]) for r in encode.encode(made).orderBy("element_id").collect()]
    assert got == [(1, "1.2. A"), (0, ""), (1, ""), (2, ""), (3, ""), (0, ""), (0, ""), (0, "")]


def test_accepted_formats(spark):
    names = spark.createDataFrame([("A.PDF",), ("b.doc",), ("c.tif",), ("d",), (None,)], "path string")
    got = [tuple(r) for r in names.select(*[routing.accepted(names.path, w) for w in ("pdf", "docx", "detector")]).collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]
    assert {r["way"]: r["takes_bytes"] for r in routing.ways(spark).collect()} == {"pdf": True, "docx": False, "detector": True}


class _Page:
    def get_text(self, kind):
        span = {"text": "Hi", "bbox": (1, 2, 3, 4), "font": "F-Bold", "size": 16.0, "flags": 16, "color": 255}
        line = {"bbox": (1, 2, 3, 4), "spans": [span, span | {"text": " "}]}
        return {"blocks": [{"type": 0, "bbox": (0, 0, 9, 9), "lines": [line]}, {"type": 1, "bbox": (0, 0, 9, 9)}]}

    def get_pixmap(self, dpi):
        return types.SimpleNamespace(width=dpi, height=2 * dpi, tobytes=lambda kind: kind.encode())


def test_pdf_provider_with_a_library_in_place_of_the_real_one(spark, monkeypatch):
    @contextlib.contextmanager
    def opened(stream, filetype):
        if not stream.startswith(b"%PDF"):
            raise ValueError("no objects found")
        yield [_Page()] * int(stream[4:])

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=opened))
    files = pd.DataFrame({"doc_id": [1, 2, 3], "content": [b"%PDF2", b"no", None]})
    got = pd.concat(pdf.Pages().rows([files]))
    assert got.page_number.tolist() == [1, 2, None, None] and got.error.isna().tolist() == [True, True, False, False]
    pages = spark.createDataFrame(got.to_numpy().tolist(), pdf.Pages.schema)
    assert [(r["doc_id"], r["page_number"], r["element_id"], r["text"], r["bold"]) for r in spans.span_elements(pages).collect()] == [(1, 1, 1, "Hi", True), (1, 2, 2, "Hi", True)]
    assert {r["doc_id"] for r in pdf.failures(pages).collect()} == {2, 3}
    images = pd.concat(pdf.Rasters(72).rows([files]))
    assert images.png.tolist() == [b"png", b"png", None, None] and images.height.tolist()[:2] == [144, 144]


def test_pdf_provider_says_what_it_lacks(monkeypatch):
    for name in ("pymupdf", "fitz"):
        monkeypatch.setitem(sys.modules, name, None)
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        list(pdf.Pages().rows([]))


def test_blocks_of_vectors_give_the_distances_of_single_pairs(spark, monkeypatch):
    import random

    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(100, [1.0, 2.0]), (101, None), (102, [None] * 8), (103, [0.0] * 8), (104, []), (None, [1.0] * 8), (150, [0.5] * 8)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    monkeypatch.setattr(encode, "QUERY_BLOCK", 2)
    monkeypatch.setattr(encode, "ROW_BLOCK", 16)
    monkeypatch.setattr(encode, "PAIRS", 20)
    q = v.where("id % 50 = 0 or id > 99")
    got = encode.cosines_against_all(q, v, 6).collect()
    plain = q.select(F.col("id").alias("a"), F.col("vector").alias("x")).crossJoin(v.select(F.col("id").alias("b"), F.col("vector").alias("y")))
    want = plain.select("a", "b", F.round(encode.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance")).collect()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rounding_without_decimals_is_that_of_decimals(spark):
    values = [0.0, -0.0, 0.5, 1.0000000005, 0.1234567885, 2.5e-10, 5e-10, -5e-10, -0.3333333333333, 0.30000000049999999, 1e17, float("nan"), float("inf"), None] + [i / 7919 for i in range(500)] + [(2 * i + 1) / 2e9 for i in range(500)]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    rows = x.select(encode.rounded(F.col("x"), 9).alias("a"), F.round("x", 9).alias("b")).collect()
    assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]


def test_pages_of_a_batch_become_python_objects_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(merge, "PAGES_AT_ONCE", 2)
    monkeypatch.setattr(merge, "to_arrow_type", lambda kind: pa.list_(pa.struct([("n", pa.int64())])))
    monkeypatch.setattr(merge, "merged", lambda page: seen.append(len(page)) or [{"n": len(page)}])
    one = dict.fromkeys(merge._FIELDS, None) | {"element_id": 1}
    out = merge._fold.func(pa.array([[one], [one, one], []]))
    assert seen == [1, 2, 0] and out.to_pylist() == [[{"n": 1}], [{"n": 2}], [{"n": 0}]]


def test_heading_tree_shuffles_once(spark):
    rows = spark.createDataFrame([(1, 0, "t", 0), (1, 1, "A", 1), (1, 2, "B", 2), (1, 3, "C", 1), (None, 0, "D", 1), (None, 1, "E", 2)], "doc_id long, ord long, text string, heading_level int")
    tree = sections.heading_tree(rows)
    assert tree._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["doc_id"], r["sec_idx"]): r["parent_idx"] for r in tree.collect()} == {(1, -1): None, (1, 1): None, (1, 2): 1, (1, 3): None, (None, 0): None, (None, 1): None}


def test_blocks_of_pages_leave_python_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(html, "LETTERS_AT_ONCE", 10)
    pages = spark.createDataFrame([(i, f"<h1>t{i}</h1><p>x</p>") for i in range(30)] + [(30, None), (31, "")], "page_id long, html string").coalesce(1)
    got = sorted((r["page_id"], r["ord"], r["text"]) for r in html.html_blocks(pages).collect())
    assert got == sorted([(i, 0, f"t{i}") for i in range(30)] + [(i, 1, "x") for i in range(30)])


def test_pairs_beyond_the_threshold_are_not_sorted(spark):
    codes = encode.encode(spark.createDataFrame([(1, 1, i, "Title", f"t{i}", 12.0, "left", float(i), 1.0, 100.0, 9.0) for i in range(4)], "doc_id long, page_number int, element_id long, element_type string, text string, font_size double, alignment string, x1 double, y1 double, x2 double, y2 double"))
    plan = encode.similar(codes, threshold=0.25, k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "0.25" in plan[plan.index("Window") :]


def test_pairs_that_repeat_in_a_batch_are_compared_once():
    from quirefold.functions import fuzzy

    calls = []
    assert fuzzy._each_pair(lambda a, b: calls.append(1) or 1, ["a", "a", None], ["b", "b", "b"]) == [1, 1, None] and len(calls) == 1
    a, b = pd.Series(["large ring", "ring", "", None, "x" * 70]), pd.Series(["ring", "large ring", "a", "b", "y" + "x" * 80])
    assert fuzzy.indel_partial_ratio.func(a, b).astype(object).where(lambda s: s.notna(), None).tolist() == [100.0, 100.0, 0.0, None, 100.0]
