"""The corpus pipeline: each stage against a plain version of what it must keep of its own input."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quirefold.llm import langid, mixing, oracles, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", score string, lang_pred int, row string, key string, k int, __at string, __size int, __row int, `a.b` int, root long"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    draw = random.Random(8)
    parts = {"en": "the and tion ing er ou sh".split(), "de": "der und ung keit sch ein ö".split()}

    def text(lang, n):
        return " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randrange(2, 5))) for _ in range(n))

    items = [(i, text("en", 20)) for i in range(3)]
    rows = []
    for i in range(300):
        lang = draw.choice(list(parts))
        rows.append([i, text(lang, draw.randrange(20, 60)), lang, draw.choice(["a", "a", "a", "b", None]), 1])
    for i in range(200, 230):
        rows[i][1] = rows[i - 100][1] + (" tail" if i % 2 else "")  # exact and near copies
    for i in range(240, 250):
        rows[i][1] += " " + items[i % 3][1] + " ending words"
    rows += [[300, "12 34 56", "en", "b", 8], [301, None, None, None, None], [302, "", "en", "b", 0], [None, text("de", 40), "de", "a", 1], [303, text("en", 30_000), "en", "b", 1], [0, rows[0][1], "en", "a", 1]]
    rows += [[None, rows[5][1], "en", "a", 1], [None, text("en", 30) + " " + items[0][1], "en", "a", 1], [7, text("en", 25) + " " + items[1][1], "en", "a", 1], [9, text("de", 30), "de", None, 1]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    more = ("x", 1, "r", "k", 2, "at", 3, 4, 5, 6)  # columns whose names the stages might use themselves
    spark.createDataFrame([(*r, *more) for r in rows], WIDE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def plain(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def grams(text, letters_only=False):
    low = (text or "").lower()
    words = [w for w in re.split(r"[\W_]+", low) if w] if letters_only else re.findall(r"[^\x20\x09-\x0D]+", low)
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([] if letters_only or not words else [tuple(words)])


def groups_of(rows):
    """Lists of row numbers, by links of 5 words and 0.8 between all pairs."""
    sets, root = [set(grams(r[1])) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i) if sets[i] else ("alone", i), []).append(i)
    return list(out.values())


def leaks(text, items):
    have = grams(text, True)
    for _, item in items:
        want = Counter(grams(item, True))
        n = sum(want.values())
        for at in range(len(have)):
            window = Counter(have[at : at + n])
            both = sum((window & want).values())
            if both >= 0.8 * (sum(window.values()) + n - both):
                return True
    return False


def served(rows):
    """How often weighted fair queueing takes each row: every entry of both epochs in order of finish time, cut at the budget."""
    sized = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(n for r, n in sized if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    budget = 1.5 * sum(size.values())
    target, full = {}, set()
    while True:
        rest = budget - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[t] for t in sources if t not in full) for s in sources}
        over = {s for s in sources if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    entries = []
    for s in sources:
        line = sorted((hashlib.md5(f"mix-{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, n, i) for i, (r, n) in enumerate(sized) if r[3] == s)
        upto = 0
        for key, doc, n, i in line:
            upto += n
            if n:
                name = "-" if s is None else "=" + s
                entries += [(upto / target[s], name, key, doc, 1, n, i), ((size[s] + upto) / target[s], name, key, doc, 2, n, i)]
    spent, taken = 0, Counter()
    for *_, n, i in sorted(entries):
        spent += n
        if spent <= budget:
            taken[i] += 1
    return taken


def test_stages(spark, base, tmp_path):
    path, items = base
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "benchmark", "mixture", "shards"]
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        out = stage(spark, docs, path)
        if name != "shards":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r)[:5] for r in before.collect()] if name != "shards" else []
        if name == "language":
            gone = Counter(rows) - plain(docs)
            assert {300, 301, 302} <= {r[0] for r in gone} and gone.total() < 10
        elif name == "near_duplicates":
            found, dropped = plain(docs), 0
            for group in groups_of(rows):
                first = min((rows[i][0] is None, rows[i][0] or 0) for i in group)
                stay = Counter(rows[i] for i in group)
                left = [r for r in stay if found[r]]
                assert len(left) == 1 and found[left[0]] == 1 and (left[0][0] is None, left[0][0] or 0) == first
                dropped += len(group) - 1
            assert found.total() == len(rows) - dropped and dropped >= 32
        elif name == "benchmark":
            assert plain(docs) == Counter(r for r in rows if not leaks(r[1], items))
            assert {None, 7, 9} <= {r[0] for r in docs.select("doc_id").collect()} and len(rows) - docs.count() == 12
        elif name == "mixture":
            want = Counter()
            for i, n in served(rows).items():
                want[rows[i]] += n
            assert plain(docs) == want
    shards = kept["shards"].collect()
    assert len(shards) == kept["mixture"].count()
    counts = Counter(r["shard"] for r in shards)
    assert max(counts.values()) - min(counts[s] for s in range(sharding.SHARDS)) <= 1
    again = cp.run(spark, path)
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(map(tuple, sorted(again.collect(), key=key)), key=str) == sorted(map(tuple, sorted(shards, key=key)), key=str)


def test_a_row_is_judged_by_its_own_text(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item), (None, text(1)), (7, text(2) + " " + item), (7, text(3)), (8, text(4)), (8, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in cp.benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    rows = [(1, text(1)), (5, text(1) + " more"), (5, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (1, text(1)), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[7], rows[8]], key=str)


def test_nothing_to_learn_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1)], SCHEMA)
    assert cp.language(spark, docs, "").count() == 1


def test_last_slot_is_cut_again(spark, base, monkeypatch):
    docs = spark.read.parquet(f"{base[0]}/documents.parquet")
    want = plain(mixing.mixed(docs))
    monkeypatch.setattr(mixing, "SLOTS", 2)
    monkeypatch.setattr(mixing, "LAST_ROWS", 2)
    assert plain(mixing.mixed(docs)) == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] and set(oracles.ORACLES) <= set(queries.QUERIES)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert langid.UNKNOWN == "und" and F is not None


def test_near_copies_between_the_limits_go(spark):
    words = [f"v{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words[:100]), "en", "a", 1), (2, " ".join(words), "en", "a", 1), (3, "other words", "en", "a", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == [1, 3]
