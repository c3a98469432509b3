"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Each shard owns `points` virtual nodes on a ring of 65,536 positions; a document belongs to the first
virtual node at or clockwise after the hash of its doc_id. A shard holds at most its bound; documents
beyond it continue clockwise to the next virtual node whose shard has room. With slack 0 the bounds are
the floor and ceiling of the mean, so shard sizes differ by one row at most (law `rows`); a larger slack
moves fewer documents and lets counts differ by up to that share.

How it runs: one narrow aggregation counts documents per arc (at most shards x points rows, whatever the
input), the driver walks those counts around the ring twice, and the walk's segments join back to the
documents' ranks within their arcs. Ranks come from one global range sort of narrow rows, not from windows over arcs,
so neither a shard nor the rows without an id, or with one id, are one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import literal_table, stash, utf8_bytes

#: Ring positions are the first four hexadecimal digits of an MD5.
CELLS = 1 << 16
SHARDS = 24
POINTS = 128


def ring_arcs(n_shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node in ring order; the lowest shard wins a shared position."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for point in range(points):
            cell = int(hashlib.md5(f"shard-{shard}-{point}".encode()).hexdigest()[:4], 16)
            at.setdefault(cell, shard)
    return sorted(at.items())


def bounds(n_rows: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Most rows per shard; with slack 0 they add up to n_rows."""
    if slack > 0:
        return [-int(-(1 + slack) * n_rows // n_shards)] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def walk_ring(arcs: list[tuple[int, int]], counts: dict[int, int], limit: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, slot of the first rank).

    Every shard first takes the documents of its own arcs in ring order up to its bound; the rest queue up
    and are carried clockwise, first in first out, for two laps, each shard taking what it has room for.
    """
    room, used = list(limit), [0] * len(limit)
    segments, spill = [], {}
    for arc, (_, shard) in enumerate(arcs):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        if own:
            segments.append((arc, 0, own, shard, used[shard]))
            room[shard] -= own
            used[shard] += own
        if n > own:
            spill[arc] = (own, n)
    queue: list[list[int]] = []
    for lap in range(2):
        for arc, (_, shard) in enumerate(arcs):
            while queue and room[shard]:
                source, lo, hi = queue[0]
                take = min(hi - lo, room[shard])
                segments.append((source, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                if lo + take == hi:
                    queue.pop(0)
                else:
                    queue[0][1] += take
            if lap == 0 and arc in spill:
                queue.append([arc, *spill[arc]])
    return segments


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, points: int = POINTS, slack: float = 0.0) -> DataFrame:
    """Every row of `docs` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text counts as empty; null doc_ids, and equal ones, share one ring
    position and are told apart by checksum and size. Repeated rows get slots of their own. An empty table
    gives an empty result. Other columns of `docs` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    arcs = ring_arcs(n_shards, points)
    cells = [cell for cell, _ in arcs]
    arc_of_cell, j = [], 0
    for cell in range(CELLS):
        while j < len(cells) and cells[j] < cell:
            j += 1
        arc_of_cell.append(j % len(arcs))
    lookup = F.from_json(F.lit(str(arc_of_cell)), "array<int>")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    arc = F.element_at(lookup, F.conv(F.substring(key, 1, 4), 16, 10).cast("int") + 1)

    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), crc.alias("text_crc32"), key.alias("ring_key"), arc.alias("arc"))
    rows = stash(rows, "ring")  # narrow; texts are read once
    order = ("arc", "ring_key", "doc_id", "size", "text_crc32")
    # Row numbers of the sorted parts, written, and the places where parts and arcs begin.
    rows = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "ring-sorted")
    part, at = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    # As many rows as arcs and parts, whatever the input.
    found = rows.groupBy(part.alias("part"), "arc").agg(F.count("*").alias("n")).orderBy("part", "arc").collect()
    begins, starts, total = {}, {}, 0
    for r in found:
        begins.setdefault(r["part"], total)
        starts.setdefault(r["arc"], total)
        total += r["n"]
    offsets = literal_table(spark, [(r["part"], r["arc"], begins[r["part"]] - starts[r["arc"]]) for r in found], "part int, arc int, before long")
    counts: dict[int, int] = {}
    for r in found:
        counts[r["arc"]] = counts.get(r["arc"], 0) + r["n"]
    limit = bounds(sum(counts.values()), n_shards, slack)
    # Bounded by the ring (n_shards x points arcs, each split a few times), never by the documents.
    segments = literal_table(spark, walk_ring(arcs, counts, limit), "arc int, lo long, hi long, shard int, slot0 long")

    ranked = rows.withColumn("part", part).join(F.broadcast(offsets), ["part", "arc"]).withColumn("rank", F.col("before") + at)
    placed = ranked.join(F.broadcast(segments), "arc").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if slack <= 0 else "bounded").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
