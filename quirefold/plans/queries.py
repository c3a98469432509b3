"""One query per operator, over whole tables, with its SQL beside it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, geometry, numbering, style
from ..functions import text as tx
from ..functions.geometry import Box
from ..operators import elements, encode, merge, outline, sections, spatial, tables
from ..sources import html, routing, spans
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _big(df: DataFrame) -> DataFrame:
    """Integers as 64 bits, as SQL gives them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# --- sections, end to end -----------------------------------------------------------------------------------------

_CONTENT = """owned AS (
  SELECT l.*, last_value(t.title_idx IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ord ROWS UNBOUNDED PRECEDING) AS owner, t.title_idx IS NOT NULL AS is_title
  FROM lines l LEFT JOIN titles t ON t.doc_id = l.doc_id AND t.element_ord = l.ord
), bodies AS (
  SELECT doc_id, owner AS title_idx, string_agg(trim(text), chr(10) ORDER BY ord) AS content FROM owned WHERE NOT is_title AND owner IS NOT NULL GROUP BY 1, 2
)"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule titles with the element each stands for."""
    return fx.titles(spark, sf_dir)


def _by_doc(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(*order)


@query(f"""WITH {fx.TITLES}, {_CONTENT}
SELECT t.doc_id, CAST(t.title_idx AS BIGINT) AS title_idx, t.number, CAST(t.level AS BIGINT) AS level, t.title, coalesce(b.content, '') AS content, sha256(t.title || '|' || coalesce(b.content, '')) AS section_hash
FROM titles t LEFT JOIN bodies b USING (doc_id, title_idx)""")
def sections_of_documents(spark, sf_dir):
    """Lines, rule outline on the lines themselves, contents between titles, hashes; one shuffle."""
    out = sections.of_marked(fx.lines(spark, sf_dir), F.length("text") <= 40)
    number = outline.rule_number(F.col("title_idx"))
    return _big(out.select("doc_id", "title_idx", F.rtrim(number, F.lit(".")).alias("number"), tx.outline_level(number).alias("level"), "title", "content", "section_hash"))


@query(f"""WITH {fx.TITLES}, {_CONTENT}
SELECT t.doc_id, CAST(t.title_idx AS BIGINT) AS title_idx, t.element_ord, coalesce(b.content, '') AS content FROM titles t LEFT JOIN bodies b USING (doc_id, title_idx)""")
def section_contents(spark, sf_dir):
    """Contents of titles that were matched to elements."""
    out = sections.contents(_titled(spark, sf_dir), fx.lines(spark, sf_dir))
    return _big(out.select("doc_id", "title_idx", "element_ord", "content"))


@query(f"WITH {fx.LINES} SELECT doc_id, ord, text, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(text) AS BIGINT) AS char_end, 0.0::DOUBLE AS x1, CAST(line * 20 AS DOUBLE) AS y1, 500.0::DOUBLE AS x2, CAST(line * 20 + 15 AS DOUBLE) AS y2 FROM lines")
def line_elements(spark, sf_dir):
    """Lines with running offsets and synthetic boxes."""
    return _big(fx.lines(spark, sf_dir))


@query(f"WITH {fx.LINES} SELECT doc_id, string_agg(trim(text), chr(10) ORDER BY ord) AS text FROM lines GROUP BY doc_id")
def document_text(spark, sf_dir):
    """Ordered text of each document."""
    return elements.document_text(fx.lines(spark, sf_dir))


@query(f"""WITH {fx.TITLES}, w AS (
  SELECT *, {', '.join(f"max(CASE WHEN level = {k} THEN title_idx END) OVER p AS l{k}" for k in range(4))} FROM titles WINDOW p AS (PARTITION BY doc_id ORDER BY title_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(title_idx AS BIGINT) AS title_idx, CAST(level AS BIGINT) AS level, CAST(CASE level WHEN 1 THEN l0 WHEN 2 THEN coalesce(l1, l0) WHEN 3 THEN coalesce(l2, l1, l0) END AS BIGINT) AS parent_idx FROM w""")
def section_parents(spark, sf_dir):
    """Parents by level, ended branches included."""
    return _big(sections.parents(fx.titles(spark, sf_dir), max_level=3).select("doc_id", "title_idx", "level", "parent_idx"))


@query(f"""WITH RECURSIVE {fx.TITLES}, {_CONTENT}, w AS (
  SELECT *, {', '.join(f"max(CASE WHEN level = {k} THEN title_idx END) OVER p AS l{k}" for k in range(4))} FROM titles WINDOW p AS (PARTITION BY doc_id ORDER BY title_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), up AS (SELECT doc_id, title_idx, level, title, CASE level WHEN 1 THEN l0 WHEN 2 THEN coalesce(l1, l0) WHEN 3 THEN coalesce(l2, l1, l0) END AS parent FROM w
), tree AS (
  SELECT doc_id, title_idx, level, title AS path, lpad(CAST(title_idx AS VARCHAR), 10, '0') AS k FROM up WHERE parent IS NULL
  UNION ALL SELECT u.doc_id, u.title_idx, u.level, t.path || '-' || u.title, t.k || '/' || lpad(CAST(u.title_idx AS VARCHAR), 10, '0') FROM up u JOIN tree t ON t.doc_id = u.doc_id AND t.title_idx = u.parent
)
SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY k) - 1 AS sec_idx, path AS title, coalesce(b.content, '') AS content, CAST(level AS BIGINT) AS level FROM tree t LEFT JOIN bodies b USING (doc_id, title_idx)""")
def flat_sections(spark, sf_dir):
    """Paths of titles in depth-first order."""
    found = sections.contents(sections.parents(_titled(spark, sf_dir), max_level=3), fx.lines(spark, sf_dir))
    return _big(sections.flatten(found))


@query(f"""WITH RECURSIVE {fx.TITLES}, found AS (
  SELECT doc_id, -1 AS title_idx, CAST(0 AS BIGINT) AS at, CAST(NULL AS BIGINT) AS element_ord FROM (SELECT DISTINCT doc_id FROM titles)
  UNION ALL
  SELECT f.doc_id, f.title_idx + 1, coalesce(m.hit, f.at), m.hit FROM found f JOIN (
    SELECT g.doc_id, g.title_idx, min(l.ord) AS hit FROM found g JOIN titles t ON t.doc_id = g.doc_id AND t.title_idx = g.title_idx + 1
    LEFT JOIN lines l ON l.doc_id = g.doc_id AND l.ord >= g.at AND contains(l.text, t.title) GROUP BY 1, 2) m ON m.doc_id = f.doc_id AND m.title_idx = f.title_idx
)
SELECT doc_id, CAST(title_idx AS BIGINT) AS title_idx, element_ord FROM found WHERE title_idx >= 0""")
def titles_to_elements(spark, sf_dir):
    """Ordered match of titles to elements by containment (J8 exact)."""
    out = outline.match_titles(fx.titles(spark, sf_dir), fx.lines(spark, sf_dir), fuzzy=False)
    return _big(out.select("doc_id", "title_idx", "element_ord"))


@query()
def titles_to_elements_fuzzy(spark, sf_dir):
    """Ordered fuzzy match (J8, T8, T9); rows only: SQL has no Indel ratio."""
    return outline.match_titles(fx.titles(spark, sf_dir), fx.lines(spark, sf_dir)).select("doc_id", "title_idx", "element_ord")


@query(f"""WITH {fx.LINES}, l AS (SELECT doc_id, ord, text, CASE WHEN length(text) <= 40 THEN 1 + ord % 3 ELSE 0 END AS hl FROM lines
), o AS (SELECT *, coalesce(last_value(CASE WHEN hl > 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), -1) AS sec_idx FROM l
), h AS (SELECT doc_id, ord, hl FROM l WHERE hl > 0
), p AS (SELECT a.doc_id, a.ord, max(b.ord) AS parent_idx FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.ord < a.ord AND b.hl < a.hl GROUP BY 1, 2)
SELECT o.doc_id, o.sec_idx, max(CASE WHEN hl > 0 THEN text END) AS title, max(hl) AS level, coalesce(string_agg(CASE WHEN hl = 0 THEN trim(text) END, chr(10) ORDER BY o.ord), '') AS content, max(p.parent_idx) AS parent_idx
FROM o LEFT JOIN p ON p.doc_id = o.doc_id AND p.ord = o.ord GROUP BY 1, 2""")
def heading_tree(spark, sf_dir):
    """Sections from heading levels by a stack."""
    rows = fx.lines(spark, sf_dir).withColumn("heading_level", F.when(F.length("text") <= 40, 1 + F.col("ord") % 3).otherwise(0))
    return _big(sections.heading_tree(rows))


@query(f"WITH {fx.TITLES} SELECT doc_id, CAST(title_idx AS BIGINT) AS title_idx, CAST(level AS BIGINT) AS level, number, trim(title) AS title FROM titles")
def outline_parse(spark, sf_dir):
    """Numbered lines to level, number and title."""
    lines = fx.titles(spark, sf_dir).select("doc_id", F.col("title_idx").alias("line_no"), F.concat_ws(" ", "token", "title").alias("line"))
    return _big(outline.number_lines(lines))


@query(f"WITH {fx.TITLES} SELECT doc_id, CAST(title_idx AS BIGINT) AS line_no, token || ' ' || title AS line, title_idx = max(title_idx) OVER (PARTITION BY doc_id) AS closed FROM titles")
def outline_stream(spark, sf_dir):
    """Outlines streamed in pieces of seven characters, as complete lines (ST1, ST5, ST6)."""
    import tempfile
    import uuid

    from ..streaming.outline import completed_lines

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:  # one machine has its own folder, any other session the warehouse, which a cluster shares
        shared = tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    base = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    made = fx.chunks(spark, sf_dir)
    made.write.parquet(f"{base}/in")
    stream = completed_lines(spark.readStream.schema(made.schema).parquet(f"{base}/in"))
    done = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return _big(spark.read.schema(stream.schema).parquet(f"{base}/out"))


@query(f"""WITH {fx.TITLES}, d AS (SELECT doc_id, max(title_idx) AS top FROM titles GROUP BY 1)
SELECT doc_id, CAST(title_idx AS BIGINT) AS title_idx, title FROM titles JOIN d USING (doc_id) WHERE title_idx < top OR doc_id % 2 = 0""")
def finished_sections(spark, sf_dir):
    """Sections that a growing outline can change no more (ST4, Q24); documents of even id have ended."""
    t = fx.titles(spark, sf_dir)
    return _big(sections.finished(t.select("doc_id", "title_idx", "title"), t.where("doc_id % 2 = 0")))


@query(f"WITH {fx.TITLES} SELECT doc_id, CAST(title_idx AS BIGINT) AS title_idx, title FROM titles")
def latest_snapshot(spark, sf_dir):
    """The last of several snapshots of each document."""
    t = fx.titles(spark, sf_dir).select("doc_id", "title_idx", "title")
    n = F.row_number().over(_by_doc(F.desc("title_idx")))
    early = t.withColumn("n", n).where("n > 1").drop("n").withColumn("snapshot", F.lit(1))
    return _big(sections.latest(early.union(t.withColumn("snapshot", F.lit(2)))))


# --- boxes ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.BOXES} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, element_id, element_type, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, (x2 - x1) * (y2 - y1) AS area, x1 * 2.0::DOUBLE AS x1_scaled, y2 * 2.0::DOUBLE AS y2_scaled
FROM boxes WHERE confidence >= 0.5 AND element_type NOT IN ('Abandon', 'Figure')""")
def box_geometry(spark, sf_dir):
    """Width, height, centre, area, scale; confidence and type filters."""
    b, big = Box.of(), Box.of().scaled(2.0)
    rows = elements.without_types(elements.with_confidence(fx.boxes(spark, sf_dir)), "Abandon", "Figure")
    return _big(rows.select("doc_id", "page_number", "element_id", "element_type", b.width.alias("width"), b.height.alias("height"), b.center_x.alias("center_x"), b.center_y.alias("center_y"), b.area.alias("area"), big.x1.alias("x1_scaled"), big.y2.alias("y2_scaled")))


@query(f"WITH {fx.BOXES} SELECT doc_id, element_type, count(*) AS n FROM boxes WHERE element_type IN ('Title', 'Table') AND page_number = 2 GROUP BY 1, 2")
def type_counts(spark, sf_dir):
    """Counts by type on one page."""
    return elements.type_counts(elements.on_page(elements.of_types(fx.boxes(spark, sf_dir), "Title", "Table"), 2))


@query(f"WITH {fx.BOXES} SELECT doc_id, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 9) AS mean, round(quantile_cont(confidence, 0.5), 9) AS median, count(*) AS n FROM boxes GROUP BY 1")
def confidence_stats(spark, sf_dir):
    """Least, most, mean and median confidence (A3)."""
    return elements.confidence_stats(fx.boxes(spark, sf_dir)).withColumns({"mean": F.round("mean", 9), "median": F.round("median", 9)})


@query(f"WITH {fx.BOXES} SELECT doc_id, count(*) AS n_elements, count(DISTINCT page_number) AS n_pages FROM boxes GROUP BY 1")
def document_summary(spark, sf_dir):
    """Elements and pages per document."""
    return elements.document_summary(fx.boxes(spark, sf_dir))


@query(f"WITH {fx.BOXES} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, count(*) AS n FROM boxes GROUP BY 1, 2")
def page_groups(spark, sf_dir):
    """Elements per page."""
    return _big(elements.pages(fx.boxes(spark, sf_dir)))


@query(f"WITH {fx.BOXES} SELECT doc_id, element_id, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, element_id) - 1 AS ord, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (x2 - x1) * (y2 - y1) DESC, element_id) AS area_rank FROM boxes")
def reading_order(spark, sf_dir):
    """Order by height and left edge; rank by area."""
    return _big(elements.by_area(elements.reading_order(fx.boxes(spark, sf_dir))).select("doc_id", "element_id", "ord", "area_rank"))


_OVERLAP = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"""WITH {fx.BOXES}, p AS (
  SELECT a.doc_id, a.page_number, a.element_id AS a_id, b.element_id AS b_id, {_OVERLAP} AS shared, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab,
         a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2 AS inside
  FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.element_id < b.element_id)
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, a_id, b_id, shared, round(shared / (aa + ab - shared), 9) AS iou, round(shared / least(aa, ab), 9) AS of_smaller, inside FROM p WHERE shared > 0""")
def overlapping_boxes(spark, sf_dir):
    """Pairs of boxes of a page that overlap."""
    a, b = encode.sided(fx.boxes(spark, sf_dir), "a_", "doc_id", "page_number"), encode.sided(fx.boxes(spark, sf_dir), "b_", "doc_id", "page_number")
    x, y = Box.of("a_"), Box.of("b_")
    pairs = a.join(b, ["doc_id", "page_number"]).where((F.col("a_element_id") < F.col("b_element_id")) & (geometry.intersection(x, y) > 0))
    return _big(pairs.select("doc_id", "page_number", F.col("a_element_id").alias("a_id"), F.col("b_element_id").alias("b_id"), geometry.intersection(x, y).alias("shared"), F.round(geometry.iou(x, y), 9).alias("iou"), F.round(geometry.overlap_of_smaller(x, y), 9).alias("of_smaller"), geometry.contains(x, y).alias("inside")))


_MATCH = f"""matched AS (
  SELECT a.doc_id, a.page_number, a.element_id AS box_id, b.element_id AS span_id, b.text, b.font_name FROM boxes a LEFT JOIN spans b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND (
    {_OVERLAP} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_OVERLAP}) >= 0.01 OR {_OVERLAP} / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.1
    OR (a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2)))"""


@query(f"WITH {fx.BOXES}, {fx.SPANS}, {_MATCH} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, box_id, span_id FROM matched")
def boxes_to_spans(spark, sf_dir):
    """Left spatial join of boxes and spans."""
    out = spatial.match_spans(fx.boxes(spark, sf_dir), fx.spans(spark, sf_dir))
    return _big(out.select("doc_id", "page_number", F.col("b_element_id").alias("box_id"), F.col("s_element_id").alias("span_id")))


@query(f"WITH {fx.BOXES}, {fx.SPANS}, {_MATCH} SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, box_id, span_id FROM matched")
def boxes_to_spans_banded(spark, sf_dir):
    """The same by horizontal bands (J1, dense pages)."""
    out = spatial.match_spans_banded(fx.boxes(spark, sf_dir), fx.spans(spark, sf_dir))
    return _big(out.select("doc_id", "page_number", F.col("b_element_id").alias("box_id"), F.col("s_element_id").alias("span_id")))


@query(f"""WITH {fx.BOXES}, {fx.SPANS}, {_MATCH}
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, box_id AS element_id, coalesce(string_agg(text, '' ORDER BY span_id), '') AS text, count(span_id) AS n_runs, arg_min(font_name, span_id) AS font_name, coalesce(sum(length(text)), 0)::BIGINT AS last_end FROM matched GROUP BY 1, 2, 3""")
def enriched_boxes(spark, sf_dir):
    """Boxes with text and runs of their spans, offsets shifted."""
    out = merge.enrich(spatial.match_spans(fx.boxes(spark, sf_dir), fx.spans(spark, sf_dir)))
    return _big(out.select("doc_id", "page_number", "element_id", "text", "n_runs", "font_name", F.coalesce(F.array_max(F.transform("runs", lambda r: r["end_index"])), F.lit(0)).cast("long").alias("last_end")))


@query(f"""WITH RECURSIVE {fx.BOXES}, ranked AS (
  SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (x2 - x1) * (y2 - y1) DESC, element_id) AS n FROM boxes
), keep(doc_id, page_number, n, kept) AS (
  SELECT doc_id, page_number, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, area DOUBLE)[]) FROM (SELECT DISTINCT doc_id, page_number FROM boxes)
  UNION ALL
  SELECT k.doc_id, k.page_number, r.n, CASE WHEN len(list_filter(k.kept, lambda b: greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1)) > 0.9 * least(b.area, r.area))) > 0 THEN k.kept
         ELSE list_append(k.kept, {{'id': r.element_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'area': r.area}}) END
  FROM keep k JOIN ranked r ON r.doc_id = k.doc_id AND r.page_number = k.page_number AND r.n = k.n + 1
), last AS (SELECT doc_id, page_number, arg_max(kept, n) AS kept FROM keep GROUP BY 1, 2)
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, unnest(kept).id AS element_id FROM last""")
def suppressed_boxes(spark, sf_dir):
    """Greedy suppression of overlapping boxes."""
    return _big(spatial.suppress_overlaps(fx.boxes(spark, sf_dir)).select("doc_id", "page_number", "element_id"))


@query(f"""WITH RECURSIVE {fx.BOXES}, ys AS (SELECT doc_id, page_number, y1, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y1) AS n FROM (SELECT DISTINCT doc_id, page_number, y1 FROM boxes)
), fold AS (
  SELECT doc_id, page_number, y1, n, 0 AS line, y1 AS top FROM ys WHERE n = 1
  UNION ALL SELECT y.doc_id, y.page_number, y.y1, y.n, f.line + CASE WHEN y.y1 > f.top + 0.5 THEN 1 ELSE 0 END, CASE WHEN y.y1 > f.top + 0.5 THEN y.y1 ELSE f.top END
  FROM fold f JOIN ys y ON y.doc_id = f.doc_id AND y.page_number = f.page_number AND y.n = f.n + 1
)
SELECT b.doc_id, CAST(b.page_number AS BIGINT) AS page_number, b.element_id, CAST(f.line AS BIGINT) AS line, row_number() OVER (PARTITION BY b.doc_id, b.page_number, f.line ORDER BY b.x1, b.element_id) - 1 AS pos
FROM boxes b JOIN fold f ON f.doc_id = b.doc_id AND f.page_number = b.page_number AND f.y1 = b.y1""")
def box_lines(spark, sf_dir):
    """Boxes in lines by anchor height."""
    return _big(merge.group_lines(fx.boxes(spark, sf_dir)).select("doc_id", "page_number", "element_id", "line", "pos"))


@query(f"""WITH {fx.BOXES}, t AS (SELECT doc_id, page_number, element_id AS table_id, x1, y1, x2, y2 FROM boxes WHERE element_type = 'Table Caption')
SELECT a.doc_id, CAST(a.page_number AS BIGINT) AS page_number, a.element_id, max(t.table_id) AS table_id FROM boxes a LEFT JOIN t ON a.doc_id = t.doc_id AND a.page_number = t.page_number AND a.x1 <= t.x1 * 0.95 AND a.y1 <= t.y1 * 0.95 AND a.x2 >= t.x2 * 0.95 AND a.y2 >= t.y2 * 0.95 GROUP BY 1, 2, 3""")
def tables_in_elements(spark, sf_dir):
    """Last table that each element contains."""
    b = fx.boxes(spark, sf_dir)
    t = elements.of_types(b, "Table Caption").select("doc_id", "page_number", F.col("element_id").alias("table_id"), "x1", "y1", "x2", "y2")
    return _big(spatial.table_of_elements(b, t, 0.95).select("doc_id", "page_number", "element_id", "table_id"))


# --- spans ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.STYLED}
SELECT doc_id, element_id, bold, italic, underline, alignment, '#' || lpad(lower(hex(color_value)), 6, '0') AS color,
       CASE WHEN font_size >= 18 THEN 1 WHEN font_size >= 16 THEN 2 WHEN font_size >= 14 THEN 3 WHEN bold AND font_size >= 12 THEN 4 ELSE 0 END::BIGINT AS heading_level,
       'font-' || CAST(font_size AS INT) || 'pt' || CASE WHEN bold THEN '-Bold' ELSE '' END || CASE WHEN italic THEN '-Italic' ELSE '' END AS style_name,
       substr(md5(text), 1, 16) AS text_key, replace(text, ' ', '') AS packed FROM styled""")
def span_styles(spark, sf_dir):
    """Weight, slant, colour, alignment, heading level, style name, key."""
    s = fx.styled(spark, sf_dir)
    return _big(s.select("doc_id", "element_id", "bold", "italic", "underline", "alignment", style.with_hash(style.hex_color(F.col("color_value"))).alias("color"), style.pdf_heading_level(F.col("font_size"), F.col("bold")).alias("heading_level"), style.style_name(F.col("font_size"), F.col("bold"), F.col("italic")).alias("style_name"), tx.text_key(F.col("text")).alias("text_key"), tx.without_space(F.col("text")).alias("packed")))


@query(f"""WITH {fx.STYLED}, d AS (
  SELECT doc_id, page_number, element_id, '[id:' || element_id || '][page:' || page_number || '][type:' || element_type || '][' || font_name || ' ' || CAST(font_size AS DECIMAL(20, 1)) || 'pt]' ||
       CASE WHEN italic THEN '[italic:True]' ELSE '' END || CASE WHEN bold THEN '[bold:True]' ELSE '' END || CASE WHEN underline THEN '[underline:True]' ELSE '' END || '[alignment:' || alignment || ']' || text AS line FROM styled)
SELECT doc_id, string_agg(line, chr(10) ORDER BY page_number, element_id) AS display FROM d GROUP BY 1""")
def display_text(spark, sf_dir):
    """Printable lines of each document, joined."""
    line = tx.display_line(*[F.col(c) for c in ("element_id", "page_number", "element_type", "font_name", "font_size")], F.lit("#000000"), F.col("italic"), F.col("bold"), F.col("underline"), F.col("alignment"), F.col("text"))
    return fx.styled(spark, sf_dir).groupBy("doc_id").agg(tx.ordered_text(F.struct("page_number", "element_id"), line).alias("display"))


@query(f"""WITH {fx.SPANS}, d AS (SELECT doc_id, page_number, element_id AS drawing_id, x1 + (element_id % 7) * 9 - 20 AS x1, y1 + element_id % 13 - 2 AS y1, x1 + (element_id % 7) * 9 + element_id AS x2, y1 + element_id % 13 - 2 + element_id % 3 AS y2 FROM spans WHERE element_id % 3 = 0)
SELECT s.doc_id, CAST(s.page_number AS BIGINT) AS page_number, s.element_id, d.drawing_id, d.x2 - d.x1 AS length, greatest(CAST(trunc((d.x2 - d.x1) / 8) AS BIGINT), 6) AS underscores, abs(d.y2 - d.y1) < 2 AS is_horizontal
FROM spans s JOIN d ON s.doc_id = d.doc_id AND s.page_number = d.page_number AND abs(d.y1 - s.y1) <= 10 AND d.x1 >= s.x1 - 10 AND d.x1 <= s.x2 + 50""")
def underlines_near_spans(spark, sf_dir):
    """Drawn lines near spans."""
    s, e = fx.spans(spark, sf_dir), F.col("element_id")
    d = s.where(e % 3 == 0).select("doc_id", "page_number", e.alias("drawing_id"), (F.col("x1") + (e % 7) * 9 - 20).alias("x1"), (F.col("y1") + e % 13 - 2).alias("y1"), (F.col("x1") + (e % 7) * 9 + e).alias("x2"), (F.col("y1") + e % 13 - 2 + e % 3).alias("y2"))
    return _big(spatial.nearby_underlines(s, d).withColumnRenamed("d_drawing_id", "drawing_id"))


_SUPER = """marked AS (
  SELECT *, CASE WHEN element_id % 4 = 1 THEN CAST(element_id % 9 + 1 AS VARCHAR) ELSE text END AS t FROM spans
), s AS (SELECT * FROM marked WHERE CAST(font_size < 10 AS INT) + CAST(length(t) <= 3 AS INT) + CAST(regexp_matches(t, '^[0-9]+$') AS INT) * 2 >= 2
), cand AS (
  SELECT s.doc_id, s.page_number, s.element_id, m.element_id AS main_id, m.y1 AS my, m.x1 AS mx, s.x1 - m.x2 AS across, abs(m.y1 - s.y1) AS down,
         1.0::DOUBLE / (1.0 + (s.x1 - m.x2) + abs(m.y1 - s.y1) * 2) * CASE WHEN s.font_size / m.font_size < 0.8 THEN 1.5 ELSE 1.0 END AS score
  FROM s JOIN marked m ON s.doc_id = m.doc_id AND s.page_number = m.page_number AND s.element_id <> m.element_id AND m.x2 <= s.x2 AND m.y1 >= s.y1 - 5 AND m.y1 <= s.y2 + 10 AND s.x1 - m.x2 BETWEEN 0 AND 50
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, element_id ORDER BY score DESC, across, down, main_id) AS n FROM cand) WHERE n = 1)"""


@query(f"WITH {fx.SPANS}, {_SUPER} SELECT s.doc_id, s.element_id, b.main_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.page_number, coalesce(b.my, s.y1), coalesce(b.mx + 0.1, s.x1), s.element_id) - 1 AS ord FROM marked s LEFT JOIN best b ON b.doc_id = s.doc_id AND b.page_number = s.page_number AND b.element_id = s.element_id")
def superscript_order(spark, sf_dir):
    """Reading order with superscripts after their texts."""
    e = F.col("element_id")
    marked = fx.spans(spark, sf_dir).withColumn("text", F.when(e % 4 == 1, (e % 9 + 1).cast("string")).otherwise(F.col("text")))
    return _big(spatial.order_with_superscripts(marked).select("doc_id", "element_id", "main_id", "ord"))


@query()
def merged_fragments(spark, sf_dir):
    """Greedy merging of text fragments (U4, A5); rows only, tested against a fold over the document."""
    return merge.merge_fragments(fx.styled(spark, sf_dir)).select("doc_id", "page_number", "element_id", "text", "n_merged", "x1", "y1", "x2", "y2")


@query(f"""WITH {fx.STYLED}, pages AS (SELECT doc_id, page_number, element_id, text, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, element_id) AS n FROM styled)
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, n AS element_id, text, font_size FROM pages""")
def decoded_spans(spark, sf_dir):
    """Elements from decoded pages of nested blocks, lines and spans."""
    s = fx.styled(spark, sf_dir)
    box = lambda: F.struct("x1", "y1", "x2", "y2")
    span = F.struct("text", box().alias("bbox"), F.col("font_name").alias("font"), F.col("font_size").alias("size"), "flags", F.col("color_value").cast("int").alias("color"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("element_id").alias("k"), F.struct(box().alias("bbox"), F.array(span).alias("spans")).alias("line"))))
    block = F.struct(F.lit(0).alias("type"), F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(600.0).alias("x2"), F.lit(800.0).alias("y2")).alias("bbox"), F.transform("ls", lambda x: x["line"]).alias("lines"))
    pages = s.groupBy("doc_id", "page_number").agg(lines.alias("ls")).select("doc_id", "page_number", F.array(block).alias("blocks"))
    return _big(spans.span_elements(pages).select("doc_id", "page_number", "element_id", "text", "font_size"))


# --- numbering and fuzzy text --------------------------------------------------------------------------------------

#: Title, then type, path and level read by hand.
TITLE_NUMBERS = (
    ("第二十三章 x", "chinese_unit", "23", 0), ("第六百一十条 x", "chinese_unit", "610", 0), ("第一百二十三条", "chinese_unit", "123", 0), ("第三千五百条", "chinese_unit", "3500", 0), ("（一）x", "chinese_parenthetical", "1", 1),
    ("(十二) x", "chinese_parenthetical", "12", 1), ("(12) x", "arabic_parenthetical", "12", 1), ("17.1 Title", "arabic_decimal", "17.1", 1), ("1. Intro", "arabic_decimal", "1", 0), ("1.1.a foo", "mixed_alphanumeric", "1.1.a", 2),
    ("a.i foo", "mixed_alphanumeric", "a.1", 1), ("A1.2 x", "mixed_alphanumeric", "A1.2", 1), ("IV Overview", "arabic_decimal", "4", 0), ("C. Item", "mixed_alphanumeric", "c", 0), ("Hello world", "mixed_alphanumeric", "hello", 0),
    ("违约责任", "mixed_alphanumeric", "", 0), ("17 x", "arabic_decimal", "17", 0), ("17.2 y", "arabic_decimal", "17.2", 1), ("第一条 a", "chinese_unit", "1", 0), ("第二条 b", "chinese_unit", "2", 0), ("第二章 c", "chinese_unit", "2", 0), ("(1) d", "arabic_parenthetical", "1", 1),
)


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles read by hand as document -1, and the numbered titles of all documents."""
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(-1L, {i}, '{t[0]}')" for i, t in enumerate(TITLE_NUMBERS)) + " AS t(doc_id, title_idx, text)")
    made = fx.titles(spark, sf_dir).select("doc_id", "title_idx", F.concat_ws(" ", "token", "title").alias("text"))
    return rows.union(made).withColumn("number", numbering.title_number(F.col("text")))


_NUMBERS = f"""v AS (
  SELECT * FROM (VALUES {", ".join(f"(CAST(-1 AS BIGINT), {i}, '{t}', '{k}', '{p}', {n}, '{next((c for c in t if k == 'chinese_unit' and c in numbering.CLAUSE_UNITS), '')}')" for i, (t, k, p, n) in enumerate(TITLE_NUMBERS))}) v(d, i, t, k, p, n, u)
  UNION ALL SELECT doc_id, title_idx, token || ' ' || title, 'arabic_decimal', number, len(string_split(number, '.')) - 1, '' FROM titles)"""


@query(f"WITH {fx.TITLES}, {_NUMBERS} SELECT d AS doc_id, CAST(i AS BIGINT) AS title_idx, t AS text, k AS number_type, p AS path, CAST(n AS BIGINT) AS level FROM v")
def title_numbers(spark, sf_dir):
    """Number types, paths and levels of titles."""
    return _big(_numbers(spark, sf_dir).select("doc_id", "title_idx", "text", F.col("number.number_type").alias("number_type"), numbering.hierarchy_path(F.col("number")).alias("path"), F.col("number.level").alias("level")))


@query(f"""WITH {fx.TITLES}, {_NUMBERS}, q AS (SELECT *, string_split(p, '.') AS parts FROM v)
SELECT a.d AS doc_id, CAST(a.i AS BIGINT) AS a_idx, CAST(b.i AS BIGINT) AS b_idx,
  CASE WHEN a.n = b.n AND len(a.parts) = len(b.parts) AND CASE WHEN len(a.parts) = 1 THEN a.k = b.k AND a.u = b.u ELSE a.parts[:-2] = b.parts[:-2] END THEN 'sibling'
       WHEN b.n = a.n + 1 AND len(b.parts) = len(a.parts) + 1 AND b.parts[:-2] = a.parts THEN 'parent_child' WHEN a.n = b.n + 1 AND len(a.parts) = len(b.parts) + 1 AND a.parts[:-2] = b.parts THEN 'child_parent' ELSE 'unrelated' END AS relation
FROM q a JOIN q b ON a.d = b.d AND a.i < b.i""")
def title_relations(spark, sf_dir):
    """Relations of a document's numbered titles."""
    return _big(outline.relate(_numbers(spark, sf_dir), numbering.relation(F.col("a_number"), F.col("b_number"))))


@query()
def fuzzy_ratios(spark, sf_dir):
    """Ratios of part names with the next part's (T8, T9, T12); rows only: SQL has no Indel ratio."""
    p = fx.read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    a, b = F.col("a"), F.col("b")
    return pairs.select("p_partkey", fuzzy.indel_ratio(a, b).alias("ratio"), fuzzy.indel_partial_ratio(a, b).alias("partial"), fuzzy.indel_token_sort_ratio(a, b).alias("sorted"), fuzzy.fuzzy_title(a, b).alias("matches"), F.size(fuzzy.near_spans(a, F.split(b, " "))).alias("near"))


@query("""SELECT p_partkey, CASE WHEN instr(p_name || '：' || p_brand || p_type, p_name) = 0 THEN '' ELSE regexp_replace(p_brand, '^[：:]+', '') END AS content FROM part""")
def own_content(spark, sf_dir):
    """Content of a title inside a shared element, up to the next title."""
    element = F.concat("p_name", F.lit("："), "p_brand", "p_type")
    return fx.read(spark, sf_dir, "part").select("p_partkey", tx.own_content(element, F.col("p_name"), F.col("p_type")).alias("content"))


# --- encodings ------------------------------------------------------------------------------------------------------


_CODES = rf"""WITH {fx.STYLED}, st AS (
  SELECT doc_id, min(font_size) AS s0, max(font_size) AS s1, min(length(text)) AS n0, max(length(text)) AS n1, max(x2 - x1) AS w, max(y2 - y1) AS h FROM styled GROUP BY 1
), ys AS (SELECT doc_id, page_number, y1, lag(b) OVER p AS above, lead(y1) OVER p AS below FROM (SELECT doc_id, page_number, y1, arg_min(y2, element_id) AS b FROM styled GROUP BY 1, 2, 3) WINDOW p AS (PARTITION BY doc_id, page_number ORDER BY y1)
), c AS (
  SELECT e.doc_id, e.page_number, e.element_id,
    CASE WHEN s1 > s0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (font_size - s0) / (s1 - s0))) ELSE 0.5 END AS font_size_norm,
    CAST(bold AS INT) + 2 * CAST(italic AS INT) + 4 * CAST(underline AS INT) AS font_style_code,
    CASE alignment WHEN 'center' THEN 1 WHEN 'right' THEN 2 WHEN 'justify' THEN 3 ELSE 0 END AS alignment_code,
    least(1.0::DOUBLE, e.x1 / w) AS pos_x, least(1.0::DOUBLE, e.y1 / h) AS pos_y,
    CASE WHEN n1 > n0 THEN CAST(length(text) - n0 AS DOUBLE) / (n1 - n0) ELSE 0.5 END AS length_norm,
    CASE element_type WHEN 'Plain Text' THEN 0 WHEN 'Title' THEN 1 WHEN 'Figure' THEN 3 WHEN 'Figure Caption' THEN 4 WHEN 'Table' THEN 5 WHEN 'Table Caption' THEN 6 ELSE 13 END AS element_type_code,
    coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (e.y1 - above) / 50)), 0.0) AS spacing_before, coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (below - e.y2) / 50)), 0.0) AS spacing_after, least(1.0::DOUBLE, e.x1 / 100) AS indentation, substr(md5(text), 1, 16) AS content_hash,
    string_split(regexp_extract(text, '^([a-zA-Z]*\d*(?:\.[a-zA-Z\d]+)*)', 1), '.') AS parts, trim(text) AS hierarchy_path
  FROM styled e JOIN st ON st.doc_id = e.doc_id JOIN ys ON ys.doc_id = e.doc_id AND ys.page_number = e.page_number AND ys.y1 = e.y1)"""


@query(f"""{_CODES}
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, element_id, round(font_size_norm, 9) AS font_size_norm, CAST(font_style_code AS BIGINT) AS font_style_code, CAST(alignment_code AS BIGINT) AS alignment_code, round(pos_x, 9) AS pos_x, round(pos_y, 9) AS pos_y,
  round(length_norm, 9) AS length_norm, CAST(element_type_code AS BIGINT) AS element_type_code, round(spacing_before, 9) AS spacing_before, round(spacing_after, 9) AS spacing_after, round(indentation, 9) AS indentation, content_hash,
  substr(md5('fs' || printf('%.2f', font_size_norm) || '_st' || font_style_code || '_al' || alignment_code || '_hl' || (len(parts) - 1) || '_et' || element_type_code), 1, 12) AS signature,
  CAST(len(parts) - 1 AS BIGINT) AS hierarchy_level, hierarchy_path, CASE WHEN regexp_full_match(array_to_string(parts, '.'), '[0-9]+([.][0-9]+)*') THEN 'arabic_decimal' ELSE 'mixed_alphanumeric' END AS number_type FROM c""")
def element_codes(spark, sf_dir):
    """Structural codes and signatures of elements."""
    c = encode.encode(fx.styled(spark, sf_dir))
    doubles = ("font_size_norm", "pos_x", "pos_y", "length_norm", "spacing_before", "spacing_after", "indentation")
    return _big(c.withColumns({d: F.round(d, 9) for d in doubles}))


@query(f"""{_CODES}, s AS (SELECT doc_id, element_id, 'L' || (len(parts) - 1) || '_' || substr(md5('fs' || printf('%.2f', font_size_norm) || '_st' || font_style_code || '_al' || alignment_code || '_hl' || (len(parts) - 1) || '_et' || element_type_code), 1, 8) AS cluster FROM c)
SELECT doc_id, cluster, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY element_id) AS element_ids FROM s GROUP BY 1, 2""")
def element_clusters(spark, sf_dir):
    """Elements by level and signature."""
    return encode.clusters(encode.encode(fx.styled(spark, sf_dir))).select("doc_id", "cluster", "n", F.array_join("element_ids", ",").alias("element_ids"))


@query()
def similar_elements(spark, sf_dir):
    """The ten nearest codes of each title of a document within 0.3 (J6, O6, D1, D5); rows only, tested by hand values."""
    codes = encode.encode(fx.styled(spark, sf_dir))
    return encode.similar(codes, targets=codes.where("element_type_code = 1"))


_DIST = {
    "structural": "CASE WHEN a.sig = b.sig THEN 0.0 ELSE (abs(a.fs - b.fs) + bit_count(xor(a.st, b.st)) / 6.0 + CAST(a.al <> b.al AS INT) + abs(a.hl - b.hl) / 10.0 + CAST(a.et <> b.et AS INT)) / 5 END",
    "hierarchical": "CASE abs(a.hl - b.hl) WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 ELSE least(1.0, abs(a.hl - b.hl) / 5.0) END",
}
_CODED = "c AS (SELECT CAST(p_partkey AS INT) AS i, p_size / 50.0::DOUBLE AS fs, CAST(p_size % 64 AS INT) AS st, CAST(p_size % 5 AS INT) AS al, CAST(p_partkey % 9 AS INT) AS hl, CAST(p_size % 14 AS INT) AS et, p_brand AS sig FROM part)"


@query(f"WITH {_CODED} SELECT CAST(a.i AS BIGINT) AS a, CAST(b.i AS BIGINT) AS b, round({_DIST['structural']}, 9) AS structural, round(CAST({_DIST['hierarchical']} AS DOUBLE), 9) AS hierarchical FROM c a JOIN c b ON a.i % 50 = 0 AND a.i <> b.i")
def code_distances(spark, sf_dir):
    """Structural and hierarchical distances of every part whose key is divisible by 50 to all others."""
    p = fx.read(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    c = p.select(k.alias("i"), (size / 50.0).alias("font_size_norm"), (size % 64).cast("int").alias("font_style_code"), (size % 5).alias("alignment_code"), (k % 9).alias("hierarchy_level"), (size % 14).alias("element_type_code"), F.col("p_brand").alias("signature"))
    pairs = encode.against_all(encode.sided(c.where("i % 50 = 0"), "a_"), encode.sided(c, "b_")).where("a_i <> b_i")
    found = pairs.select(F.col("a_i").alias("a"), F.col("b_i").alias("b"), encode.distance("structural").alias("structural"), encode.distance("hierarchical").cast("double").alias("hierarchical"))
    return _big(found.withColumns({c: encode.rounded(F.col(c), 9) for c in ("structural", "hierarchical")}))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id""")
def semantic_distances(spark, sf_dir):
    """Cosine distances of every stored vector whose id is divisible by 50 to all others."""
    v = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return encode.cosines_against_all(v.where("id % 50 = 0"), v, 6).where("a <> b")


# --- tables and sources ---------------------------------------------------------------------------------------------


@query(f"""WITH {fx.CELLS}, r AS (SELECT row, string_agg(text, ' | ' ORDER BY col) AS md, string_agg('Cell[' || (row + 1) || ',' || (col + 1) || ']: ' || text, '; ' ORDER BY col) AS rec, count(*) AS n FROM cells GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_rows, max(n) AS n_cols, CAST(sum(n) AS BIGINT) AS n_cells,
  '| ' || max(CASE WHEN row = 0 THEN md END) || ' |' || chr(10) || '|' || repeat(' --- |', CAST(max(n) AS INT)) || chr(10) || string_agg('| ' || md || ' |', chr(10) ORDER BY row) FILTER (WHERE row > 0) AS markdown,
  'Table with ' || count(*) || ' rows and ' || max(n) || ' columns' || chr(10) || string_agg('Row ' || (row + 1) || ': ' || rec, chr(10) ORDER BY row) AS record FROM r""")
def table_texts(spark, sf_dir):
    """Rows of cells as Markdown and as records."""
    t = tables.rows_of_tables(fx.cells(spark, sf_dir))
    return _big(t.select("n_rows", "n_cols", "n_cells", tables.markdown(F.col("rows")).alias("markdown"), tables.record_text(F.col("rows"), F.col("n_cols")).alias("record")))


@query(f"""WITH {fx.CELLS}, ch AS (SELECT row, col, i, substr(text, CAST(i + 1 AS INT), 1) AS c, (CASE WHEN i < 3 THEN 12.0 ELSE 10.0 END)::DOUBLE AS font_size, i % 4 = 0 AS bold FROM (SELECT *, unnest(range(length(text))) AS i FROM cells)
), m AS (SELECT *, CASE WHEN font_size IS DISTINCT FROM lag(font_size) OVER p OR bold IS DISTINCT FROM lag(bold) OVER p THEN 1 ELSE 0 END AS new FROM ch WINDOW p AS (PARTITION BY row, col ORDER BY i)
), n AS (SELECT *, sum(new) OVER (PARTITION BY row, col ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS run_no FROM m)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(run_no AS BIGINT) AS run_no, string_agg(c, '' ORDER BY i) AS text, min(i) AS start_index, max(i) + 1 AS end_index, min(font_size) AS font_size, bool_and(bold) AS bold FROM n GROUP BY 1, 2, 3""")
def cell_runs(spark, sf_dir):
    """Characters in cells as runs of one style."""
    inside = spatial.chars_in_cells(fx.chars(spark, sf_dir), fx.cell_boxes(spark, sf_dir))
    runs = tables.style_runs(inside, ["doc_id", "page_number", "c_table_id", "c_row", "c_col"])
    return _big(runs.select(F.col("c_row").alias("row"), F.col("c_col").alias("col"), "run_no", "text", "start_index", "end_index", "font_size", "bold"))


@query(f"""WITH {fx.LINES}, t AS (SELECT doc_id, ord, text, 1 AS k FROM lines WHERE length(text) <= 40), p AS (SELECT doc_id, ord, text, 0 AS k FROM lines WHERE length(text) > 40)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, ord) - 1 AS element_id, text FROM (SELECT * FROM p UNION ALL SELECT * FROM t)""")
def paragraphs_and_tables(spark, sf_dir):
    """Tables after all paragraphs."""
    lines = fx.lines(spark, sf_dir)
    return _big(tables.append_tables(lines.where(F.length("text") > 40), lines.where(F.length("text") <= 40)).select("doc_id", "element_id", "text"))


@query()
def page_blocks(spark, sf_dir):
    """Text blocks of HTML pages (S26); rows only: parsed in Python."""
    return html.html_blocks(fx.read(spark, sf_dir, "pages"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'docx' WHEN page_id % 4 = 2 THEN 'docx' END AS by_name, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS by_content,
  CASE WHEN page_id % 5 > 0 THEN 'text/html' ELSE CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 2 THEN 'application/msword' END END AS media FROM pages""")
def file_kinds(spark, sf_dir):
    """Kinds by name, by content, and media types."""
    k = F.col("page_id")
    name = F.concat(k.cast("string"), F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".docx", ".doc", ".txt")]), (k % 4 + 1).cast("int")))
    head = F.when(k % 3 == 0, F.lit("%PDF-1.7")).when(k % 3 == 1, F.lit("PK\x03\x04..")).otherwise(F.lit("GIF89a")).cast("binary")
    declared = F.when(k % 5 > 0, F.lit("text/html")).otherwise(F.lit(routing.OCTETS))
    return fx.read(spark, sf_dir, "pages").select("page_id", routing.kind_by_name(name).alias("by_name"), routing.kind_by_content(head).alias("by_content"), routing.media_type(declared, name).alias("media"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS level FROM pages""")
def style_heading_levels(spark, sf_dir):
    """Heading levels of style names."""
    k = F.col("page_id")
    names = F.element_at(F.array(*[F.lit(s) for s in ("Heading 1", "heading 12", "Title", "Subtitle", "Normal")]), (k % 5 + 1).cast("int"))
    return _big(fx.read(spark, sf_dir, "pages").select("page_id", style.docx_heading_level(names).alias("level")))


@query("""SELECT p_partkey, '#' || lpad(lower(hex(CAST(trunc((p_size % 256) / 255.0 * 255) AS BIGINT))), 2, '0') || '00ff' AS color FROM part""")
def rgb_colors(spark, sf_dir):
    """Colours of three shares (P10)."""
    return fx.read(spark, sf_dir, "part").select("p_partkey", style.rgb_color((F.col("p_size") % 256) / F.lit(255.0), F.lit(0.0), F.lit(1.0)).alias("color"))


@query(f"""WITH {fx.BOXES}, d AS (SELECT doc_id, page_number, element_id, CAST(element_id % 10 AS INT) AS cls, confidence, x1 * 0.5 AS x1, y1 * 0.5 AS y1, x2 * 0.5 AS x2, y2 * 0.5 AS y2 FROM boxes WHERE confidence >= 0.25)
SELECT doc_id, CAST(page_number AS BIGINT) AS page_number, [{', '.join(repr(t) for t in style.DETECTOR_CLASSES)}][cls + 1] AS element_type, count(*) AS n, min(x1) AS x1, max(y2) AS y2 FROM d GROUP BY 1, 2, 3""")
def detected_elements(spark, sf_dir):
    """Detector rows to elements in points, in reading order."""
    codes = F.create_map(*[F.lit(x) for i, t in enumerate(style.DETECTOR_CLASSES) for x in (t, i)])
    rows = fx.boxes(spark, sf_dir).withColumn("class_id", F.element_at(codes, F.col("element_type"))).drop("element_type", "element_id")
    out = spans.detections(rows, dpi=144)
    return _big(out.groupBy("doc_id", "page_number", "element_type").agg(F.count("*").alias("n"), F.min("x1").alias("x1"), F.max("y2").alias("y2")))
