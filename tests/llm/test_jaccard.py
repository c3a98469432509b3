"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import jaccard
from quirefold.llm.components import connected

DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, groups=25, size=8):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    common = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([3, 6, 12, 30, 80, 300]))]
        if draw.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(draw.randrange(1, size)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, len(text) // 10])):
                at = draw.randrange(len(text))
                text[at] = draw.choice([word(), text[at].upper(), word() + " " + word()])
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = jaccard.linked_components(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("limit,depth", [(4, 2), (6, 1)])
def test_large_regions_divide_without_loss(spark, monkeypatch, limit, depth):
    """With tiny limits every region goes through pivots and blocks."""
    for name, value in (("LIMIT", limit), ("DEPTH", depth), ("PIVOTS", 3), ("LOCAL_GROUP", 5), ("LARGEST_GROUP", 7), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(9, groups=12, size=25)
    got = jaccard.linked_components(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_edges(spark):
    long = "z " + " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "ONE\x0btwo"), (7, "one two three"), (6, long), (2, long + " end"), (1, "same text here now"), (1, "same text here now"), (None, "same text here now")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"cls": F.lit("clash"), "region": F.lit(1)})
    got = sorted((tuple(r) for r in jaccard.linked_components(docs).collect()), key=str)
    want = [(5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 8), (8, 1, 8), (7, 1, 7), (6, 59998, 2), (2, 59999, 2), (1, 1, 1), (1, 1, 1), (None, 1, 1)]
    assert got == sorted(want, key=str)
    assert jaccard.linked_components(spark.createDataFrame([], DOCS)).count() == 0


def test_signatures_meet_for_every_linked_pair():
    draw = np.random.default_rng(5)
    for n in (2, 5, 7, 9, 13, 20, 50, 120, 400, 1500):
        for _ in range(60):
            x = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
            k = draw.integers(0, max(1, n // 11) + 1)
            y = np.unique(np.concatenate([draw.permutation(x)[k:], draw.integers(0, 2**64, draw.integers(0, max(1, n // 11) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= 85 * (len(x) + len(y) - both) and jaccard.digest(x) != jaccard.digest(y):
                a, b = np.concatenate(jaccard.signatures(x)), np.concatenate(jaccard.signatures(y))
                assert len(np.intersect1d(a, b))
                s, t = jaccard.sketch(x), jaccard.sketch(y)
                kept = jaccard.stack([s, t], min(len(s), len(t)))
                assert jaccard._maybe_linked(np.array([len(x), len(y)]), kept, np.array([0]), np.array([1]))[0]


def test_components(spark):
    edges = [(i, i - 1) for i in range(1, 60)] + [(100, 101), (200, 200)] + [(300 + i, 300) for i in range(1, 40)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100, 200: 200} | {300 + i: 300 for i in range(40)}


def test_width_and_percent(spark):
    """A copy with a fifth more words links at 5 words and 80, not at 4 words and 85; all pairs decide both."""
    words = [f"v{i}" for i in range(120)]
    rows = [(1, " ".join(words[:100])), (2, " ".join(words[:120])), (3, " ".join(f"u{i}" for i in range(100)))]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(docs).collect()} == {1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("tiny", [False, True])
def test_equals_all_pairs_at_other_limits(spark, monkeypatch, tiny):
    if tiny:
        for name, value in (("LIMIT", 4), ("DEPTH", 2), ("PIVOTS", 3), ("LOCAL_GROUP", 5), ("LARGEST_GROUP", 7), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus(4, groups=15, size=16)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked_components(spark.createDataFrame(rows, DOCS), 5, 80).collect()}
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    want = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:  # the smallest id moves along the links
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(want.values())) < len(want)


def test_signatures_meet_at_80():
    """Every pair that links at 80 % shares a signature, unrelated sets share none, not even by one common shingle."""
    draw = np.random.default_rng(6)
    for n in (2, 5, 9, 13, 20, 50, 120, 400, 890, 1500):
        for _ in range(60):
            x = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
            k = draw.integers(0, max(1, n // 9) + 1)
            y = np.unique(np.concatenate([draw.permutation(x)[k:], draw.integers(0, 2**64, draw.integers(0, max(1, n // 9) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= 80 * (len(x) + len(y) - both) and jaccard.digest(x) != jaccard.digest(y):
                a, b = np.concatenate(jaccard.signatures(x, 80)), np.concatenate(jaccard.signatures(y, 80))
                assert len(np.intersect1d(a, b))
                s, t = jaccard.sketch(x, 80), jaccard.sketch(y, 80)
                kept = jaccard.stack([s, t], min(len(s), len(t)))
                assert jaccard._maybe_linked(np.array([len(x), len(y)]), kept, np.array([0]), np.array([1]), 80)[0]
    common = draw.integers(0, 2**64, 3, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, draw.integers(0, 2**64, 887, dtype=np.uint64)])) for _ in range(100)]
    signs = np.concatenate([s for x in sets for s in jaccard.signatures(x, 80)])
    assert len(np.unique(signs)) == len(signs)


def test_unrelated_texts_do_not_chain(spark):
    """A region of unrelated sets has no pivots that divide it: blocks copy each set to all others, which fills disks."""
    draw = random.Random(7)
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(700 + i))) for i in range(300)]
    rows.append((300, rows[0][1] + " end"))
    found = jaccard.read(spark.createDataFrame(rows, DOCS), 2, 5, 80).localCheckpoint()
    owners = found.where("part is null").selectExpr("cls", "n_shingles n", "sketch")
    edges = jaccard.chained(found.where("part is not null"), owners, 80).where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    assert edges.count() == 1


def test_sketches_of_unrelated_sets_of_one_group_differ():
    """Also where a shorter set brings the sketches of its group to fewer buckets."""
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 2**64, 700 + 2 * i, dtype=np.uint64)) for i in range(200)]
    table = pa.table({"sig": [1] * 200, "cls": range(200), "n": [len(s) for s in sets], "sketch": [jaccard.sketch(s, 80) for s in sets]})
    assert jaccard._near_edges(table, 80).num_rows == 0
