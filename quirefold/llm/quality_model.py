"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is half of
|sum v_i x_i|^2 - sum |v_i x_i|^2, so a text is scored in time linear in its features. Features are the lower-cased
words hashed to 2^BITS bins (by share of the text), statistics of its structure, and the table's character count.
Trained on the driver by AdaGrad on a bounded sample of labelled rows, whose features are made on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import held_out, text_batches

BITS, RANK = 15, 8
#: Labelled rows learned from, at most about.
MAX_TRAIN = 6000
FOLDS, FOLD = 5, 0
EPOCHS, RATE, PENALTY, WORD_SCALE, THRESHOLD = 8, 0.08, 1e-4, 3.0, 0.3
STATISTICS = ("words", "chars_per_word", "symbols", "bars", "digits", "capitals", "distinct", "repeated_next", "lines", "punctuation", "top_word", "symbol_words", "n_chars")


def _share(texts: pa.Array, pattern: str, over: np.ndarray) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(texts, pattern=pattern), dtype=np.float64) / over


def features(texts: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, shares, statistics) of each text of a null-free array."""
    found = tx.words(texts)
    bins = (_vocab_hashes(found.vocab) >> np.uint64(64 - BITS)).astype(np.int64)
    length = np.maximum(1, np.asarray(pc.utf8_length(texts), dtype=np.float64))
    symbols = _share(texts, r"[#*$%&|<>]", length)
    bars, digits = _share(texts, r"\|", length), _share(texts, r"[0-9]", length)
    capitals, points = _share(texts, r"[A-Z]", length), _share(texts, r"[.,;:!?]", length)
    lines = np.asarray(pc.count_substring(texts, pattern="\n"), dtype=np.float64)
    odd = np.asarray(pc.match_substring_regex(found.vocab, pattern=r"[#*$%&|<>]"), dtype=np.float64)
    for i in range(len(texts)):
        codes = found.codes[found.starts[i] : found.starts[i + 1]]
        n = max(1, len(codes))
        one, counts = np.unique(codes, return_counts=True)
        at, where = np.unique(bins[one], return_inverse=True)
        shares = np.bincount(where, weights=counts, minlength=len(at)) / n if len(at) else np.empty(0)
        again = float((codes[1:] == codes[:-1]).sum()) / n
        top = float(counts.max()) / n if len(counts) else 0.0
        stats = [np.log1p(len(codes)), length[i] / n, np.sqrt(symbols[i]), np.sqrt(bars[i]), np.sqrt(digits[i]), np.sqrt(capitals[i]), len(one) / n, again, np.log1p(lines[i]), np.sqrt(points[i]), top, odd[codes].mean() if len(codes) else 0.0, np.log1p(max(0.0, n_chars[i]))]
        yield at, shares, np.array(stats)


def _vocab_hashes(vocab: pa.Array) -> np.ndarray:
    digest = tx.xxhash.xxh64_intdigest
    return np.fromiter((digest(w.lower()) for w in vocab.to_pylist()), np.uint64, len(vocab))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def inputs(self, at: np.ndarray, shares: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5) / 2
        return np.concatenate([at, (1 << BITS) + np.arange(len(stats))]), np.concatenate([np.sqrt(shares) * WORD_SCALE / 3, scaled])

    def margin(self, rows: np.ndarray, x: np.ndarray) -> float:
        scaled = self.factors[rows] * x[:, None]
        total = scaled.sum(axis=0)
        return float(self.bias + self.linear[rows] @ x + 0.5 * (total @ total - (scaled * scaled).sum()))


def train(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]) -> Machine | None:
    if not samples:
        return None
    stats = np.stack([s[2] for s in samples])
    size, draw = (1 << BITS) + stats.shape[1], np.random.default_rng(0)
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    model = Machine(float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.02, (size, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    rows = [model.inputs(*s) for s in samples]
    g_bias, g_linear, g_factors = 1.0, np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            v = model.factors[at]
            scaled = v * x[:, None]
            total = scaled.sum(axis=0)
            margin = model.bias + model.linear[at] @ x + 0.5 * (total @ total - (scaled * scaled).sum())
            wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]
            d_linear = wrong * x + PENALTY * model.linear[at]
            d_factors = wrong * x[:, None] * (total - scaled) + PENALTY * v
            g_bias += wrong * wrong
            g_linear[at] += d_linear**2
            g_factors[at] += d_factors**2
            model.bias -= RATE * wrong / np.sqrt(g_bias)
            model.linear[at] -= RATE * d_linear / np.sqrt(g_linear[at])
            model.factors[at] -= RATE * d_factors / np.sqrt(g_factors[at])
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Learn quality from labelled rows outside the held-out fold; None if there are none, or either table is empty.

    A document is learned from once: of rows that share an id the one with the largest text counts, of repeated labels
    the larger, so about MAX_TRAIN rows reach the driver however often rows repeat. Rows without an id have no label. A
    null text is learned as the empty one, whole texts count however long, and other columns of both tables are ignored.
    """
    text_batches(docs.sparkSession)
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))  # of repeated labels the larger counts
    n = rows.count()
    if not n:
        return None
    share = int(min(1.0, MAX_TRAIN / n) * 1_000_000) + 1
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share)
    # The draw is about MAX_TRAIN rows whatever the table, so it may be broadcast.
    joined = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.max(F.struct("text", "n_chars")).alias("row")).select("label", "row.text", "row.n_chars", "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.as_strings(batch.column(1))
            sizes = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float))
            for lo, hi in tx.slices(column):
                made = list(features(column.slice(lo, hi - lo), sizes[lo:hi]))
                packed = [pa.array([m[k].astype(t).tobytes() for m in made], pa.binary()) for k, t in ((0, np.int32), (1, np.float32), (2, np.float64))]
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), *packed], ["doc_id", "label", "bins", "shares", "stats"])

    table = joined.mapInArrow(make, "doc_id long, label int, bins binary, shares binary, stats binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    samples = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(s, np.float32).astype(float), np.frombuffer(t, np.float64)) for b, s, t in zip(table["bins"].to_pylist(), table["shares"].to_pylist(), table["stats"].to_pylist(), strict=True)]
    return train(samples, table["label"].to_pylist())


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: quality 1 likelier) of every row; 0.5 where nothing could be learned.

    A null text counts as empty, a null n_chars as 0. lang, source and doc_id are no inputs. Repeated rows get a row
    each, with equal scores for equal text and n_chars; texts count whole, however long; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.as_strings(batch.column(1))
            sizes = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float))
            for lo, hi in tx.slices(column):
                if model is None:
                    scores = [0.5] * (hi - lo)
                else:
                    margins = np.array([model.margin(*model.inputs(*f)) for f in features(column.slice(lo, hi - lo), sizes[lo:hi])])
                    scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(run, "doc_id long, score double")
