"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, EQUIVALENT, KNOWN, NOT_WORD
from .mixing import RANGES, SLOTS, WEIGHTS  # noqa: F401
from .sharding import POINTS, SHARDS

#: CRC-32 (polynomial EDB88320) of the bytes whose hexadecimal text is `x`, as a lambda over a table of 256 entries.
CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) t(i)))
"""


def crc32(hexed: str) -> str:
    byte = f"CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(list_reduce(list_transform(range(length({hexed}) // 2), lambda i: {byte}),"
        f" lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


OP1 = f"""
WITH RECURSIVE {CRC_TABLE.strip()}, points AS (
  SELECT s, v, CAST('0x' || substr(md5('shard-' || s || '-' || v), 1, 4) AS INT) AS cell
  FROM range({SHARDS}) a(s), range({POINTS}) b(v)
), arcs AS (
  SELECT row_number() OVER (ORDER BY cell) - 1 AS arc, cell, CAST(min(s) AS INT) AS shard FROM points GROUP BY cell
), docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32("hexed")} AS text_crc32, ring_key,
         CAST('0x' || substr(ring_key, 1, 4) AS INT) AS cell
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS hexed, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ring_key FROM documents), crc_table
), ranked AS (
  SELECT d.*, coalesce(a.arc, 0) AS arc,
         row_number() OVER (PARTITION BY coalesce(a.arc, 0) ORDER BY ring_key, doc_id, size, text_crc32) - 1 AS rnk
  FROM docs d ASOF LEFT JOIN arcs a ON d.cell <= a.cell
), limits AS (
  SELECT CAST(s AS INT) AS shard, n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END AS cap
  FROM range({SHARDS}) t(s), (SELECT count(*) AS n FROM documents)
), counted AS (
  SELECT a.arc, a.shard, l.cap, coalesce(c.n, 0) AS n
  FROM arcs a JOIN limits l USING (shard) LEFT JOIN (SELECT arc, count(*) AS n FROM ranked GROUP BY arc) c USING (arc)
), own AS (
  SELECT *, greatest(0, least(n, cap - coalesce(sum(n) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept FROM counted
), own2 AS (
  SELECT *, n - kept AS spilled,
         coalesce(sum(kept) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot0,
         coalesce(sum(n - kept) OVER (ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queue0,
         sum(kept) OVER (PARTITION BY shard) AS filled
  FROM own
), total AS (SELECT count(*) AS arcs FROM arcs
), walk(step, shard, take, carry, room) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS INT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         (SELECT list(CAST(cap - filled AS BIGINT) ORDER BY shard) FROM (SELECT DISTINCT shard, cap, filled FROM own2))
  UNION ALL
  SELECT step, shard, take, carry - take + CASE WHEN step < arcs THEN spilled ELSE 0 END,
         list_transform(room, lambda x, i: CASE WHEN i = shard + 1 THEN x - take ELSE x END)
  FROM (SELECT w.step + 1 AS step, o.shard, CAST(least(w.room[o.shard + 1], w.carry) AS BIGINT) AS take, w.carry, w.room, CAST(o.spilled AS BIGINT) AS spilled, t.arcs
        FROM walk w, total t, own2 o WHERE w.step + 1 < 2 * t.arcs AND o.arc = (w.step + 1) % t.arcs)
), taken AS (
  SELECT step, shard, take, sum(take) OVER (ORDER BY step) - take AS queue_lo, sum(take) OVER (PARTITION BY shard ORDER BY step) - take AS before
  FROM walk WHERE take > 0
), placed AS (
  SELECT r.*, o.shard AS home, o.kept, o.slot0, o.queue0 + r.rnk - o.kept AS q FROM ranked r JOIN own2 o USING (arc)
)
SELECT doc_id, size, text_crc32, 'rows' AS law, home AS shard, CAST(slot0 + rnk AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed WHERE rnk < kept
UNION ALL
SELECT p.doc_id, p.size, p.text_crc32, 'rows', t.shard, CAST(f.filled + t.before + p.q - t.queue_lo AS BIGINT), NULL
FROM (SELECT * FROM placed WHERE rnk >= kept) p ASOF JOIN taken t ON p.q >= t.queue_lo
JOIN (SELECT DISTINCT shard, filled FROM own2) f ON f.shard = t.shard
"""

_MIXED = f"""
sized AS (
  SELECT doc_id, text, lang, source, n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src
  FROM {{docs}}
), sources AS (
  SELECT src, source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w
  FROM sized GROUP BY src, source
), ratio AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 3 AS twice FROM sources
), level AS (
  SELECT *, cap * 2 * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (twice - 2 * (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap)) * w AS is_full
  FROM ratio
), targets AS (
  SELECT src, source_size,
         CASE WHEN is_full THEN cap
              ELSE (twice - 2 * sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ()) * w / (2 * sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE w END) OVER ()) END AS target
  FROM level
), served AS (
  SELECT s.*, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY s.src ORDER BY key, coalesce(doc_id, 0), size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.src = t.src
), entries AS (
  SELECT *, e, CASE WHEN size > 0 THEN (CASE e WHEN 1 THEN upto ELSE source_size + upto END) / target END AS finish
  FROM served, (SELECT unnest([1, 2]) AS e)
), line AS (
  SELECT *, size > 0 AND 2 * sum(size) OVER (ORDER BY finish NULLS LAST, src, key, coalesce(doc_id, 0), e ROWS UNBOUNDED PRECEDING)
            <= (SELECT 3 * sum(size) FROM sized) AS taken
  FROM entries
)
"""

OP7 = f"""
WITH {_MIXED.format(docs='documents')}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(CASE WHEN taken THEN size ELSE 0 END) AS BIGINT) AS taken, CAST(sum(CAST(taken AS INT)) AS INT) AS copies
FROM line GROUP BY doc_id, size, source_size, target, key, upto
"""

OP8 = """
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM tokens
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, s.n AS n_shingles, m.component_id FROM sizes s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
"""

OP2 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, max(page_id) AS first_page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < g.first_page OR (p.page_id IS NULL AND g.first_page IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.first_page OR p.page_id IS NULL THEN g.first_page END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"'  ' || regexp_replace({out}, {_quoted(NOT_WORD)}, '  ', 'g') || '  '"
    for old, new in EQUIVALENT:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


OP4 = f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical('text')} AS c FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) v(license_id, text))
  WHERE c <> '' GROUP BY 1
), docs AS (SELECT doc_id, {_canonical('text')} AS c FROM documents)
SELECT d.doc_id, sha256(d.c) AS digest, CAST(length(d.c) AS BIGINT) AS n_chars, k.license_id FROM docs d LEFT JOIN known k ON k.digest = sha256(d.c)
"""

_GRAMS = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

OP6 = f"""
WITH items AS (
  SELECT item_id, g AS item, len(g) AS n FROM (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) WHERE len(g) > 0
), docs AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), places AS (SELECT doc_id, len(g) AS m, unnest(g) AS h, unnest(range(1, len(g) + 1)) AS pos FROM docs WHERE len(g) > 0
), shared AS (SELECT DISTINCT p.doc_id, p.m, p.pos, i.item_id, i.n FROM places p JOIN (SELECT item_id, n, unnest(item) AS h FROM items) i USING (h)
), spots AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(greatest(1, pos - n + 1), pos + 1)) AS pos FROM shared
), windows AS (
  SELECT b.doc_id, b.pos, b.item_id, i.item, d.g[b.pos : b.pos + i.n - 1] AS found FROM spots b JOIN items i USING (item_id) JOIN docs d USING (doc_id)
), scored AS (
  SELECT *, list_sum(list_transform(list_distinct(item), lambda x: least(len(list_filter(item, lambda y: y = x)), len(list_filter(found, lambda y: y = x))))) AS common FROM windows
), near AS (SELECT *, CAST(common AS DOUBLE) / (len(found) + len(item) - common) AS similarity FROM scored
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, list_contains(item, found[1]) DESC, pos) AS k FROM near WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(pos - 1 AS BIGINT) AS start_word, CAST(len(found) + 4 AS BIGINT) AS n_words FROM best WHERE k = 1
"""

ORACLES = {
    "op6_decontamination": OP6,
    "op4_license_scan": OP4,
    "op2_warc": OP2,
    "op8_jaccard_join": OP8,
   "op1_sharding": OP1, "op7_mixing": OP7}
