"""Quality rules by compression: Zstandard ratios of whole documents and of fixed chunks must lie in bands.

Text that compresses far better than prose repeats itself; text that hardly compresses is noise. How far prose
compresses depends on how much of it there is, so the limits depend on length. Chunks of a fixed size show a repetitive
or noisy stretch inside a long document: a document falls when too large a part of its chunks lies outside the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from . import text as tx
from .common import text_batches

LEVEL = 3
#: (bytes from, least ratio, most ratio) of compressed to plain size. The shorter a text, the less it packs and the wider
#: prose spreads, so limits lie above the largest ratio of clean prose of that length: 1.09 from 100 bytes, 0.82 from 200,
#: 0.76 from 300, 0.66 from 700, 0.61 from 1,000, 0.52 from 4,000. Base64 packs to 0.95 at 220 bytes, 0.86 at 420, 0.79 at
#: 950 and 0.76 beyond; a phrase said over and over to less than 0.1. Below 150 bytes prose and noise pack alike.
BANDS = (
    (0, 0.40, 1.30), (100, 0.40, 1.12), (150, 0.35, 1.00), (200, 0.30, 0.90), (300, 0.30, 0.84), (400, 0.30, 0.80), (550, 0.30, 0.78), (700, 0.30, 0.76), (850, 0.30, 0.74),
    (1_000, 0.25, 0.72), (2_000, 0.25, 0.68), (4_000, 0.20, 0.65), (20_000, 0.15, 0.62), (100_000, 0.10, 0.62),
)
#: Chunk size in bytes; its band; the share of chunks that may lie outside.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2_000, (0.25, 0.68), 0.125
#: Base rules: least words, most repeated words of 100.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"


def band(n_bytes: int) -> tuple[float, float]:
    return [b for b in BANDS if n_bytes >= b[0]][-1][1:]


def ratios(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Ratio of the whole text and of each chunk; the last chunk reaches back to the full size, so every byte is judged.
    A text of one chunk at most has no chunks."""
    if not data:
        return 1.0, []
    whole = len(packer.compress(data)) / len(data)
    if len(data) <= CHUNK:
        return whole, []
    starts = [*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK]
    return whole, [len(packer.compress(data[i : i + CHUNK])) / CHUNK for i in starts]


def verdict(n_bytes: int, whole: float, chunks: list[float]) -> bool:
    """Is the text kept?"""
    least, most = band(n_bytes)
    low, high = CHUNK_BAND
    outside = sum(not low <= c <= high for c in chunks)
    return least <= whole <= most and outside <= CHUNK_SHARE * len(chunks)


def repeated_words(codes: np.ndarray) -> int:
    """Words covered by windows of WINDOW words that occur twice or more, the first occurrence included."""
    ids = tx.window_ids(codes, WINDOW)
    if not len(ids):
        return 0
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    twice = np.zeros(len(ids), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip("\x20\t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "ratio": "double", "n_chunks": "long", "n_chunks_outside": "long"}


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and, of each whole text, the base measures, base_failed, kept and the compression figures.

    A null text counts as empty: no words, base_failed. kept is false where base_failed, else the verdict of the bands.
    Repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
    """

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        for batch in batches:
            column = tx.as_strings(batch.column(1))
            for lo, hi in tx.slices(column):
                texts = column.slice(lo, hi - lo)
                found = tx.words(texts)
                lengths = np.asarray(pc.utf8_length(found.vocab), dtype=np.int64)
                chars = np.concatenate([[0], np.cumsum(lengths[found.codes])])
                symbols = pc.count_substring_regex(texts, pattern=SYMBOLS).to_pylist()
                rows = []
                for i, text in enumerate(texts.to_pylist()):
                    at, end = found.starts[i], found.starts[i + 1]
                    n, again = int(end - at), repeated_words(found.codes[at:end])
                    failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
                    data = text.encode()
                    whole, chunks = ratios(data, packer)
                    low, high = CHUNK_BAND
                    rows.append((n, int(chars[end] - chars[at]), symbols[i], duplicate_lines(text), again, failed, not failed and verdict(len(data), whole, chunks), whole, len(chunks), sum(not low <= c <= high for c in chunks)))
                kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]], ["doc_id", *COLUMNS])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{c} {k}" for c, k in COLUMNS.items()]]))
