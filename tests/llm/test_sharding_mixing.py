"""Sharding and mixing against one-row-at-a-time versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import mixing, sharding

DOCS = "doc_id long, text string, source string"


def rows_of(n, seed=0):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(["a", "bb", "çç"]) for _ in range(draw.randrange(0, 40))), draw.choice(["s0"] * 6 + ["s1", "s2", None])) for i in range(n)]


def one_by_one(keys, n_shards, points):
    """Place keys on the ring one after the other: first all that fit at home, then the rest clockwise."""
    arcs = sharding.ring_arcs(n_shards, points)
    limit = sharding.bounds(len(keys), n_shards)
    load, home, queue = Counter(), {}, []
    at = lambda k: next((i for i, (c, _) in enumerate(arcs) if c >= int(hashlib.md5(str(k).encode()).hexdigest()[:4], 16)), 0)
    order = sorted(keys, key=lambda k: (at(k), hashlib.md5(str(k).encode()).hexdigest()))
    over = {}
    for k in order:
        shard = arcs[at(k)][1]
        if load[shard] < limit[shard]:
            load[shard] += 1
            home[k] = shard
        else:
            over.setdefault(at(k), []).append(k)
    for lap in range(2):
        for i, (_, shard) in enumerate(arcs):
            while queue and load[shard] < limit[shard]:
                home[queue.pop(0)] = shard
                load[shard] += 1
            if lap == 0:
                queue += over.get(i, [])
    return home


@pytest.mark.parametrize("n,shards", [(500, 24), (7, 24), (241, 5)])
def test_ring(spark, n, shards):
    got = sharding.assign_shards(spark.createDataFrame(rows_of(n), DOCS), shards, 16).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))
    want = one_by_one(range(n), shards, 16)
    assert {r["doc_id"]: r["shard"] for r in got} == want
    for r, (_, text, _) in zip(sorted(got), rows_of(n)):
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))


def test_ring_moves_little_when_it_grows():
    keys = {k: 0 for k in range(3000)}
    before, after = one_by_one(keys, 24, 128), one_by_one(keys, 25, 128)
    assert sum(before[k] != after[k] for k in keys) < 0.35 * len(keys)


def test_ring_edges(spark):
    rows = [(None, None, "x")] * 5 + [(1, "same", None)] * 7 + [(2, "", "y")]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("clash"), "size": F.lit(1)}), 4, 8).collect()
    assert len(got) == 13 and {r["size"] for r in got} == {8, 12} and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair_targets(sizes):
    """Share by weight, stop at twice the size, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = rows_of(400, seed)
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
    target = fair_targets(sizes)
    entries = []
    for source in sizes:
        order = sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(f"mix-{r[0]}".encode()).hexdigest())
        served = 0
        for epoch in (1, 2):
            for i, text, _ in order:
                if size_of(text):
                    served += size_of(text)
                    entries.append((served / target[source], "-" if source is None else f"={source}", hashlib.md5(f"mix-{i}".encode()).hexdigest(), i, epoch, size_of(text)))
    spent, taken = 0, Counter()
    for *_, i, _, n in sorted(entries):
        spent += n
        if 2 * spent > 3 * sum(sizes.values()):
            break
        taken[i] += 1
    assert {i: int(r["__first"]) + int(r["__second"]) for i, r in got.items()} == {i: taken[i] for i, _, _ in rows}
    for i, _, source in rows:
        assert got[i]["__target"] == pytest.approx(target[source]) and got[i]["__source_size"] == sizes[source]
    stream = [r["doc_id"] for r in mixing.mixed(docs).collect()]
    assert Counter(stream) == +taken


def test_mix_edges(spark):
    rows = [(None, "a b", None)] * 3 + [(1, None, "s"), (2, "", "s"), (3, "x " * 50_000, "t"), (3, "x " * 50_000, "t")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))).collect()
    assert len(got) == 7 and all(not r["__first"] for r in got if r["__size"] == 0)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, " ", "s")], DOCS)).count() == 0


def test_rows_without_id_get_every_slot_once(spark):
    rows = [(None, f"text {i}") for i in range(3000)] + [(5, f"more {i}") for i in range(1500)] + [(5, "same")] * 20
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
