"""Leaks against a scan of every window."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    best = {}
    for d, text in docs:
        g = grams(words(text))
        for i, item in items:
            want = Counter(grams(words(item)))
            n = sum(want.values())
            for at in range(len(g)) if n else ():
                have = Counter(g[at : at + n])
                both = sum((have & want).values())
                like = both / (sum(have.values()) + n - both)
                if like >= 0.8 and like > best.get((d, i), (0,))[0]:
                    best[d, i] = (like, at)
    return best


def case(seed):
    draw = random.Random(seed)
    text = lambda n: " ".join(f"w{draw.randrange(900)}" for _ in range(n))
    items = [(i, text(draw.choice([3, 5, 12, 30, 31, 45, 60]))) for i in range(12)] + [(50, "la " * 9), (51, None), (52, items_twin := text(40)), (53, items_twin)]
    docs = []
    for d in range(120):
        parts = [text(draw.randrange(0, 60))]
        for _ in range(draw.choice([0, 1, 2])):
            w = (draw.choice(items)[1] or "").split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                if w:
                    w[draw.randrange(len(w))] = draw.choice(["zz", "zz yy", ""])
            parts += [" ".join(w[draw.choice([0, 0, 2]) :]).upper().replace(" ", draw.choice([" ", ",\n", " - "])), text(draw.randrange(0, 30))]
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed,limit", [(1, 10**6), (2, 10**6), (3, 0)])
def test_equals_scan(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", limit)
    docs, items = case(seed)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in dc.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0])


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, "x " + item), (4, "q " * 60_000 + item)], DOCS).withColumns({"n": F.lit("clash"), "start": F.lit(1)})
    got = sorted((str(r["doc_id"]), r["item_id"], r["similarity"], r["start_word"]) for r in dc.leaks(docs, spark.createDataFrame([(7, item)], ITEMS)).collect())
    assert got == [("3", 7, 1.0, 0), ("4", 7, 1.0, 60_000), ("None", 7, 1.0, 1)]
    assert dc.leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert dc.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([(7, item)], ITEMS)).count() == 0


def test_fingerprint(spark):
    h = [0b1011, 0b0011, 0b0110, -1]
    row = spark.createDataFrame([(h,)], "h array<long>").select(dc.fingerprint("h").alias("f")).collect()[0]["f"]
    assert row == sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h)) - (1 << 64 if 2 * sum((x >> 63) & 1 for x in h) > len(h) else 0)


def test_blocks_find_every_fingerprint_within_the_radius():
    cut = dc._blocks()
    assert sum(b for _, b in cut) == 64 and len(cut) == dc.RADIUS + 1


def test_index_selects(spark, sf_dir, monkeypatch):
    """Of the pairs of a window and an item of its length the index meets a small part, by broadcast and by shuffle alike."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    assert want and sorted(map(tuple, dc.leaks(docs, items).collect())) == want
    monkeypatch.setattr(dc, "LONGEST", 1)  # every item skips the search and is verified at once
    assert sorted(map(tuple, dc.leaks(docs, items).collect())) == want
