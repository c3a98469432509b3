"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A document leaks an item if some window of its words, as long as the item (or what is left of the text), has a weighted
Jaccard similarity of 0.8 or more with it over 5-word shingles, each weighted by how often it occurs.

1. Windows. Moving a window that does not begin with a shingle of the item one word on never lowers its similarity, so
   the best window begins at a shingle that the item holds: only those get fingerprints, and none is missed.
2. Fingerprints. 64-bit SimHash of the window's shingles, weighted by their occurrences.
3. Search. Fingerprints are cut into RADIUS + 1 blocks; any within RADIUS bits of an item's agree with it in a block.
   Blocks of three bits alone would select little, but the window's first shingle is one of the item's: the index has a
   row for each shingle, length and block of an item, and an equi-join on all three finds every fingerprint in radius.
4. Verification. Exact weighted similarity of what was found.

Words are runs of letters and digits, lower-cased. Items of fewer than five words have no shingle and match nothing.
At similarity 0.8 a bit differs with probability acos(0.89) / pi = 0.15, so fewer than one window in 1,000 at the very
threshold lies beyond a radius of 20, and a leak has many windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Item shingles up to which they are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Counters of a fingerprint have 16 bits; longer items skip the search and are verified at once.
LONGEST = 65_535


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def shingle_list(words: Column) -> Column:
    """Hashes of the shingles in order; `words` has SHINGLE words or more."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: _at(words, i))


def fingerprint(name: str) -> Column:
    """SimHash of the array column: 16 sums of four counters packed in a long each, then the majority of each bit."""
    return F.expr(f"""aggregate(
      transform(sequence(0, 15), k -> struct(k, aggregate({name}, 0L, (s, h) -> s + (shiftrightunsigned(h, k) & 281479271743489L)) AS c)), 0L,
      (f, x) -> f | aggregate(sequence(0, 3), 0L,
        (g, j) -> g | IF(2 * (shiftrightunsigned(x.c, 16 * j) & 65535L) > size({name}), shiftleft(1L, x.k + 16 * j), 0L)))""")


def _blocks() -> list[tuple[int, int]]:
    """(shift, bits) of the RADIUS + 1 blocks."""
    cut = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def block_keys(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for lo, bits in _blocks()])


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    simple = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    slow = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return F.when(simple, F.size(F.array_intersect(a, b))).otherwise(slow)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of the best window for each document and item it leaks.

    Ties go to the first window that begins with a shingle of the item. Null and empty texts, and texts or items of fewer
    than SHINGLE words, match nothing; long texts are searched whole. Rows that repeat a doc_id (or lack one) are
    reported under it together, items that repeat an item_id each under it. doc_id may be of any type that can be
    grouped. Empty tables give an empty result. Other columns are ignored.
    """
    items = benchmark.select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE).select("item_id", shingle_list(F.col("w")).alias("item"))
    items = stash(items.withColumns({"n": F.size("item"), "item_fp": fingerprint("item")}), "items")
    sought = items.select(F.explode("item").alias("h"), "n").distinct()
    small_items = sought.count() <= BROADCAST_SHINGLES

    # Texts of fewer words explode to nothing; a filter here would split every text twice.
    read = docs.select("doc_id", word_list(F.col("text")).alias("w"))
    spots = F.explode(F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE))).alias("start")
    if small_items:
        begun = read.select("doc_id", "w", spots).withColumn("h", _at(F.col("w"), F.col("start"))).join(F.broadcast(sought), "h")
    else:
        # Narrow rows meet the shingles; the places found go back to their documents. A document's key is made once.
        read = read.withColumn("key", F.xxhash64("doc_id", "w"))
        narrow = read.select("key", "w", spots).select("key", "start", _at(F.col("w"), F.col("start")).alias("h")).join(sought, "h").select("key", "start", "h", "n").distinct()
        begun = read.join(narrow, "key")
    begun = begun.select("doc_id", "start", "h", "n", F.slice("w", F.col("start") + 1, F.col("n") + SHINGLE - 1).alias("w"))
    windows = begun.select("doc_id", "start", "h", "n", shingle_list(F.col("w")).alias("found"))
    windows = windows.withColumns({"fp": fingerprint("found"), "window": F.monotonically_increasing_id()})
    windows = stash(windows, "windows")  # written, so that no plan computes a fingerprint twice, and the numbers stay

    keyed = lambda rows, fp: rows.select("*", F.posexplode(block_keys(F.col(fp))).alias("block", "bits"))
    index = items.where(F.col("n") <= LONGEST).select("item_id", "n", "item_fp", F.explode(F.array_distinct("item")).alias("h"))
    differs = F.col("fp").bitwiseXOR(F.col("item_fp"))
    masks = F.array(*[F.lit(((1 << bits) - 1) << lo if lo + bits < 64 else (((1 << bits) - 1) << lo) - (1 << 64)) for lo, bits in _blocks()])
    first = F.array_position(F.transform(masks, lambda m: differs.bitwiseAND(m) == 0), True) - 1
    broadcast = index.count() * (RADIUS + 1) <= BROADCAST_SHINGLES
    index = keyed(index, "item_fp")

    def near(rows: DataFrame) -> DataFrame:
        met = keyed(rows.where(F.col("n") <= LONGEST), "fp").join(F.broadcast(index) if broadcast else index, ["h", "n", "block", "bits"])
        return met.where((F.bit_count(differs) <= RADIUS) & (first == F.col("block")))

    columns = ("doc_id", "start", "found", "item_id")
    if broadcast:
        pairs = near(windows).select(*columns)
    else:  # narrow rows are shuffled; windows come back by number
        pairs = near(windows.select("window", "h", "n", "fp")).select("window", "item_id").join(windows, "window").select(*columns)
    if items.where(F.col("n") > LONGEST).count():
        long = items.where(F.col("n") > LONGEST).select("item_id", "n", F.explode(F.array_distinct("item")).alias("h"))
        pairs = pairs.union(windows.where(F.col("n") > LONGEST).join(long, ["h", "n"]).select(*columns))
    whole = items.select("item_id", "item")
    pairs = pairs.join(F.broadcast(whole) if small_items else whole, "item_id")
    checked = pairs.select("*", F.explode(F.array(_common(F.col("found"), F.col("item")))).alias("both"))  # once a pair
    checked = checked.withColumn("similarity", F.col("both") / (F.size("found") + F.size("item") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.size("found").alias("n"))).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start_word"), (F.col("best.n") + SHINGLE - 1).cast("long").alias("n_words")
    )
