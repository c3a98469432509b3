"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of the id. A document's virtual finish time is the number
of its source's words up to and including it, divided by the source's target; a second epoch continues
where the first ends. Ordering all documents of all sources by finish time interleaves the sources in
proportion to their targets; the mix is that order cut where the total budget is spent.

How it runs: prefix sums are split in hash ranges within each source (4,096 of them), so a source that
holds most rows is not one task (rows without an id share a hash, so they are split by size too); finish times are range-partitioned into fixed slots of virtual time, the slot in
which the budget ends is cut into slots again until it is small, and only that is sorted to the row, which gives the
row at which a global sort would be truncated. `mixed` range-sorts the rows of the mix by finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this many halves of all words: 150 %.
BUDGET_HALVES = 3
#: No source and no document is used more often.
EPOCHS = 2
#: Hash ranges within a source, and slots of virtual time in one unit.
RANGES = 4096
SLOTS = 8192
#: Rows of a slot that one task sorts.
LAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, whole_rows: bool) -> DataFrame:
    """doc_id, source, __size, __src (no nulls), __key (shuffle order), __id, __tie and __range of each row, and the row
    itself as __row if asked for: nothing of the table keeps its own name, so no name can clash."""
    hashed = lambda value: F.md5(F.concat(F.lit("mix-"), value).cast("binary"))
    source = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))
    row = [F.struct("*").alias("__row")] if whole_rows else []
    keyed = docs.select(*row, "doc_id", "source", word_count(F.col("text")).alias("__size"), source.alias("__src"), hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("__key"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("__id"), F.xxhash64("text").alias("__tie"))
    # Ranges keep the order of (key, id, size). All rows without an id have one key, and a range for each size.
    none = hashed(F.lit(""))
    inside = F.when(F.col("__key") < none, "0").when(F.col("__key") > none, "2").otherwise(F.concat(F.lit("1"), F.lpad(F.col("__size").cast("string"), 20, "0")))
    return keyed.withColumn("__range", F.concat(F.substring("__key", 1, 3), F.when(F.substring("__key", 1, 3) == F.substring(none, 1, 3), inside).otherwise("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = BUDGET_HALVES) -> DataFrame:
    """Targets per source from (__src, source, __source_size): __src, __source_size, __target.

    Shares follow the weights; a target stops at EPOCHS times the source's size and the excess is shared
    again by weight among the others until none is above. Sorting by size per weight gives the same fixed
    point at once: sources are full from the smallest ratio up, and the rest share what is left.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight.cast("double")).withColumn("cap", (EPOCHS * F.col("__source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("twice", F.sum("__source_size").over(whole).cast("double") * halves)
        .withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * 2 * F.col("rest") <= (F.col("twice") - 2 * F.col("before")) * F.col("w"))
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("twice") - 2 * F.col("spent")) * F.col("w") / (2 * F.col("open")))
    return filled.select("__src", "__source_size", target.alias("__target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = BUDGET_HALVES, whole_rows: bool = False) -> DataFrame:
    """Every row of `docs` with its place in the mix.

    Columns: doc_id and source (with whole_rows also the whole row as the struct __row), then __size, __source_size,
    __target, __f1 and __f2 (finish times of its two epochs, null for size 0), __first and __second (is it taken?).
    Null or wordless texts have size 0 and are never taken; long texts count whole. Null sources form one source, last
    in order. Rows with equal ids, or without one, come by size, then by their texts. Repeated rows are documents of
    their own. Other columns are left alone, whatever their names. An empty table gives an empty result.
    """
    narrow = stash(_keyed(docs, False), "mix")

    # Partial sums before any shuffle: a hot source costs one row per task and range.
    ranges = narrow.groupBy("__src", "__range").agg(F.sum("__size").alias("in_range"), F.first("source").alias("source"))
    sizes = ranges.groupBy("__src").agg(F.first("source").alias("source"), F.sum("in_range").alias("__source_size"))
    targets = source_targets(sizes, weights, halves)
    upto = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("in_range").over(upto) - F.col("in_range")
    offsets = stash(ranges.withColumn("__before", before).join(targets, "__src").select("__src", "__range", "__before", "__source_size", "__target"), "mix-offsets")

    def timed(rows: DataFrame) -> DataFrame:
        """Rows with both finish times; one shuffle, shared by the window and the join."""
        here = Window.partitionBy("__src", "__range").orderBy("__key", "__id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, 0)
        served = F.col("__before") + F.col("__served")
        return (
            rows.withColumn("__served", F.sum("__size").over(here))
            .join(offsets, ["__src", "__range"])
            .withColumn("__f1", F.when(F.col("__size") > 0, served / F.col("__target")))
            .withColumn("__f2", F.when(F.col("__size") > 0, (F.col("__source_size") + served) / F.col("__target")))
        )

    def entry(finish: str, epoch: int) -> Column:
        return F.struct(F.col(finish).alias("f"), F.col("__src").alias("s"), F.col("__key").alias("k"), F.col("__id").alias("i"), F.lit(epoch).alias("e"))

    slot_of = lambda f: F.least(F.floor(f * SLOTS), F.lit(2 * SLOTS)).cast("int")
    entries = timed(narrow).where("__size > 0").select("__size", F.explode(F.array(entry("__f1", 1), entry("__f2", 2))).alias("at"))
    entries = stash(entries.withColumn("slot", slot_of(F.col("at.f"))), "mix-entries")
    filled = sorted((r["slot"], r["n"]) for r in entries.groupBy("slot").agg(F.sum("__size").alias("n")).collect())  # 2 x SLOTS + 1 rows at most
    budget, spent, last = halves * sum(n for _, n in filled) // EPOCHS, 0, -1  # twice the words of the mix
    for slot, n in filled:
        last = slot
        if 2 * (spent + n) > budget or slot == filled[-1][0]:
            break
        spent += n
    inside = entries.where(F.col("slot") == last)
    while True:  # a slot that is too large for a task is cut into slots of its own
        n, lo, hi = inside.agg(F.count("*"), F.min("at.f"), F.max("at.f")).collect()[0]
        if n <= LAST_ROWS or lo == hi:
            break
        part = F.least(F.floor((F.col("at.f") - lo) / (hi - lo) * SLOTS), F.lit(SLOTS - 1)).cast("int")
        filled, at = sorted((r["part"], r["n"]) for r in inside.groupBy(part.alias("part")).agg(F.sum("__size").alias("n")).collect()), -1
        for at, more in filled:
            if 2 * (spent + more) > budget:
                break
            spent += more if at != filled[-1][0] else 0
        inside = inside.where(part == at)
    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("upto", F.sum("__size").over(order) + spent)
    start, cut = upto.agg(F.min("at"), F.max(F.when(F.col("upto") * 2 <= budget, F.col("at")))).collect()[0]
    literal = lambda at: F.struct(F.lit(at["f"]).alias("f"), F.lit(at["s"]).alias("s"), F.lit(at["k"]).alias("k"), F.lit(at["i"]).cast("long").alias("i"), F.lit(at["e"]).alias("e"))
    if cut is not None:
        within = lambda f, epoch: entry(f, epoch) <= literal(cut)
    elif start is not None:
        within = lambda f, epoch: entry(f, epoch) < literal(start)
    else:
        within = lambda f, epoch: F.lit(False)
    taken = lambda f, epoch: (F.col("__size") > 0) & F.coalesce(within(f, epoch), F.lit(False))
    return timed(_keyed(docs, True) if whole_rows else narrow).withColumns({"__first": taken("__f1", 1), "__second": taken("__f2", 2)})


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `docs`, whatever their names: each taken row once for each epoch it is taken
    in, in order of virtual finish time (rows of one time in any order). Rows are as in `mix`."""
    out = mix(docs, whole_rows=True, **options)
    both = F.filter(F.array(F.when(F.col("__first"), F.col("__f1")), F.when(F.col("__second"), F.col("__f2"))), lambda t: t.isNotNull())
    rows = out.where("__first or __second").select("__row", F.explode(both).alias("__at"))
    return rows.repartitionByRange(F.col("__at")).sortWithinPartitions("__at").select("__row.*")
