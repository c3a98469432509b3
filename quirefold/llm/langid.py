"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters of the whole text (anything else reads as a space).
Document frequencies cover every document that may be learned from; weights are trained on the driver, by
follow-the-regularised-leader with elastic-net penalties (proximal, per coordinate), on a bounded sample of them, and
a temperature is then fitted on rows of the sample kept apart. Scoring is one pass: a table lookup per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import text as tx
from .common import held_out, text_batches

BITS, ORDERS = 16, 3
#: Learned from: about so many rows at most, one in CALIBRATE of them for the temperature.
MAX_TRAIN, CALIBRATE = 4000, 5
FOLDS, FOLD = 4, 2
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 0.05, 4, 30.0
UNKNOWN = "und"
_SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a space; the last entry stands for the others."""
    if "letters" not in _tables:
        table = np.full(0x10001, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
        table[0x10000] = 0x10000  # letters beyond the plane count as one letter
        _tables["letters"] = table
    return _tables["letters"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the n-grams that begin at each character [order, position], text starts, letters per text."""
    raw = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = _letters()[np.minimum(raw, 0x10000)]
    high = raw >= 0x10000
    if high.any():
        chars = chars.copy()
        chars[high] = [0x10000 if chr(c).isalpha() else 32 for c in raw[high]]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    n = len(chars) - 2
    bins = np.empty((ORDERS, n), np.uint32)
    acc = np.zeros(n, np.uint32)
    for k in range(ORDERS):
        acc = (acc ^ (acc >> np.uint32(15))) * np.uint32(_SALTS[k]) + chars[k : k + n]
        bins[k] = (acc * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    letters = np.concatenate([[0], np.cumsum(chars != 32)])
    return bins, starts, letters[starts + lengths] - letters[starts]


def _each(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    strings = tx.as_strings(column)
    for lo, hi in tx.slices(strings, limit):
        yield lo, hi, strings.slice(lo, hi - lo).to_pylist()


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Of every bin, in how many texts it occurs; the last entry counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros((1 << BITS) + 1, np.int64), np.zeros(1 << BITS, bool), 0
        for batch in batches:
            for _, _, texts in _each(batch.column(0)):
                bins, starts, _ = grams(texts)
                for t, at in zip(texts, starts, strict=True):
                    seen[bins[:, at : at + len(t)].ravel()] = True
                    found = np.flatnonzero(seen)
                    total[found] += 1
                    seen[found] = False
                n += len(texts)
        total[-1] = n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bin", "n"])

    found = docs.select("text").where("text is not null").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)  # as long as the feature space, whatever the input
    out[found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # [bin, language], IDF and scale included
    bias: np.ndarray
    temperature: float


def _rows(docs: DataFrame, idf: np.ndarray) -> pa.Table:
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _each(batch.column(1)):
                bins, starts, letters = grams(texts)
                keys, values = [], []
                for t, at in zip(texts, starts, strict=True):
                    found, counts = np.unique(bins[:, at : at + len(t)], return_counts=True)
                    keys.append(found.astype(np.int32).tobytes())
                    values.append((counts / max(1, len(t)) * idf[found] * SCALE).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["lang", "bins", "x"]).filter(pa.array(letters > 0))

    return docs.select("lang", "text").mapInArrow(featurise, "lang string, bins binary, x binary").orderBy(F.xxhash64("bins"), "lang").toArrow()


def fit(docs: DataFrame, learn_from: Column) -> Model | None:
    """Train on rows of `docs` (doc_id, text, lang) for which learn_from holds; None if there are none, or no text of
    them has a letter.

    Rows are drawn by id and text, and rows equal in both are learned from once (with the smallest lang), so about
    MAX_TRAIN rows reach the driver however often ids, missing ids or texts repeat.
    """
    text_batches(docs.sparkSession)
    rows = docs.where(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = rows.select("lang").count()
    if not n:
        return None
    frequency = document_frequencies(rows)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])).astype(np.float32) + 1
    share = min(1.0, MAX_TRAIN / n)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9), "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = _rows(drawn.groupBy("doc_id", "text").agg(F.min("lang").alias("lang")), idf)
    if not sample.num_rows:
        return None
    label = sample["lang"].to_pylist()
    bins = [np.frombuffer(b, np.int32) for b in sample["bins"].to_pylist()]
    values = [np.frombuffer(b, np.float32) for b in sample["x"].to_pylist()]
    langs = sorted(set(label))
    code = {lang: k for k, lang in enumerate(langs)}
    apart = [i for i in range(len(label)) if i % CALIBRATE == 0 and len(label) > 10 * CALIBRATE]
    train = [i for i in range(len(label)) if i not in set(apart)]
    size = 1 << BITS
    z, squares = np.zeros((size + 1, len(langs))), np.zeros((size + 1, len(langs)))

    def weights(rows: np.ndarray) -> np.ndarray:
        part, l1 = z[rows], np.where(rows == size, 0, L1)[:, None]
        return np.where(np.abs(part) <= l1, 0.0, -(part - np.sign(part) * l1) / ((BETA + np.sqrt(squares[rows])) / ALPHA + L2))

    with_bias = lambda i: (np.append(bins[i], size), np.append(values[i], np.float32(1)))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(train):
            at, x = with_bias(i)
            w = weights(at)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[code[label[i]]] -= 1
            gradient = x[:, None] * p
            step = (np.sqrt(squares[at] + gradient**2) - np.sqrt(squares[at])) / ALPHA
            z[at] += gradient - step * w
            squares[at] += gradient**2
    final = weights(np.arange(size + 1))
    scores = np.array([with_bias(i)[1] @ final[with_bias(i)[0]] for i in apart])
    truth = np.array([code[label[i]] for i in apart], dtype=int)

    def loss(temperature: float) -> float:
        s = scores / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(axis=1))).mean())

    del z, squares, bins, values, sample
    tx.tidy()
    temperature = min(np.exp(np.linspace(np.log(0.2), np.log(5), 60)), key=loss) if apart else 1.0
    return Model(langs, (final[:size] * idf[:, None] * SCALE).astype(np.float32), final[size], float(temperature))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred and score; `und` and 0 where the text is null, empty or has no letter, or nothing was learned.

    Equal texts get equal results wherever they stand, repeated rows a row each, an empty table an empty result; texts
    count whole, however long. A column of `docs` called lang_pred or score is an error: wrap such a table's rows in a
    struct, which passes through.
    """
    text_batches(docs.sparkSession)
    names = docs.columns
    clash = {n.lower() for n in names} & {"lang_pred", "score"}
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for _, _, texts in _each(batch.column(names.index("text"))):
                if model is None:
                    lang += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                bins, starts, letters = grams(texts)
                for t, at, n in zip(texts, starts, letters, strict=True):
                    if not n:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    counts = np.bincount(bins[:, at : at + len(t)].ravel(), minlength=1 << BITS) if len(t) > 20_000 else None
                    total = counts @ model.weights if counts is not None else model.weights[bins[:, at : at + len(t)].ravel()].sum(axis=0, dtype=np.float64)
                    s = (total / len(t) + model.bias) / model.temperature
                    p = np.exp(s - s.max())
                    k = int(p.argmax())
                    lang.append(model.langs[k])
                    score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of `docs` outside the held-out fold and predict every row: doc_id, text, lang_pred, score.

    lang, source and doc_id are inputs of no prediction. Null langs are not learned from; an empty table gives an
    empty result.
    """
    model = fit(docs, ~held_out(F.col("doc_id"), FOLDS, FOLD))
    return predict(docs.select("doc_id", "text"), model)
