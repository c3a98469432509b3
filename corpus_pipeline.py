"""The corpus pipeline: five stages, each over all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next. All but the last return the columns of `documents`, whatever else the
table holds and however its columns are named. A row is told from others by its doc_id and its text, so rows without an
id, or with an id that several texts share, are judged each for itself. An empty table passes every stage as an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quirefold.llm import decontaminate, jaccard, langid, mixing, sharding
from quirefold.llm.common import small, stash, table

#: Predictions below this calibrated probability are rejected, as are texts without a letter. Texts that mix languages
#: score from 0.4 up and are clean, so the limit lies below them.
LEAST_LANGUAGE_SCORE = 0.4
#: Lists of rows up to this many (32 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Near copies share this percentage of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no name of the table meets a name of ours."""
    return docs.select(F.struct("*").alias("row"))


def _without(docs: DataFrame, out: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose keys (expressions over row.*) are not among those of `out`; null matches null."""
    out = small(stash(out.select(*keys).distinct(), "out"), BROADCAST_ROWS)
    same = F.lit(True)
    for name, value in keys.items():
        same = same & value.eqNullSafe(F.col(name))
    return _whole(docs).join(out, same, "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go. Where no row has a language
    to learn from, nothing can be rejected and all rows stay."""
    model = langid.fit(docs, ~langid.held_out(F.col("doc_id"), langid.FOLDS, langid.FOLD))
    if model is None:
        return docs
    named = langid.predict(docs.select("text", F.struct("*").alias("row")), model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id, those without an id last, among
    texts of one id the one with the smallest hash. Of rows with equal id and text one stays. Null texts and texts
    without words are in no group, so they stay, all of them."""
    linked = stash(jaccard.linked_rows(docs, NEAR_WIDTH, NEAR_PERCENT).where("root is not null"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    groups = linked.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    twice = lambda rows: rows.withColumn("k", F.xxhash64("root"))  # noqa: E731  (a second key, so that Spark can split the partition of one group)
    inside = twice(linked).join(twice(groups), ["root", "k"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    keys = {"doc_id": F.col("row.doc_id").cast("long"), "text_key": jaccard.text_key(F.col("row.text"))}
    kept = _without(docs, inside.where(~is_first), keys)
    again = stash(inside.where(is_first).groupBy("doc_id", "text_key").agg(F.count("*").alias("times")).where("times > 1").select(*keys), "again")
    if not again.count():
        return kept
    same = F.lit(True)
    for name, value in keys.items():
        same = same & value.eqNullSafe(F.col(name))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    repeated = _whole(kept).join(small(again, BROADCAST_ROWS), same).groupBy(*keys).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return _without(kept, again, keys).unionByName(repeated.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Whether a document leaks is a matter of its text, so rows are known by
    128 bits of it; null texts stay."""
    digest = lambda text: {"a": F.xxhash64(text), "b": F.xxhash64(F.lit("b"), text)}
    by_text = docs.select(F.struct(*[c.alias(n) for n, c in digest(F.col("text")).items()]).alias("doc_id"), "text")
    found = decontaminate.leaks(by_text, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id.*"), digest(F.col("row.text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken. Null texts and texts without words weigh nothing
    and are not taken; rows without a source form a source."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, repeated rows included."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

#: Language identification learns its model, which SQL cannot express; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over `documents`: the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
