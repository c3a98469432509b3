"""Batch text kernels shared by the operators of this subpackage.

A batch of texts becomes one flat array of word codes plus document offsets, so that
shingling, window counting and feature hashing run in numpy over the batch and Python
touches each *distinct* word of a batch once, never each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text worked on at once; a single longer text is still taken whole.
SLICE_BYTES = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def tidy() -> None:
    """Give freed memory back before the worker idles until its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the GNU C library


@dataclass
class Words:
    """codes[starts[i]:starts[i+1]] are the words of text i, as indexes of vocab."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each (at least one row)."""
    n = len(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null reads as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def words(texts: pa.Array, gap: str = WORD_GAP) -> Words:
    """Split each text of a null-free string array."""
    parts = pc.split_pattern_regex(texts, pattern=gap)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    kept = np.concatenate([[0], np.cumsum(full)])
    starts = kept[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int64), starts, coded.dictionary)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` consecutive word hashes, order kept."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i : i + n]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def window_ids(codes: np.ndarray, width: int) -> np.ndarray:
    """Exact ids of the windows of `width` codes: equal ids mean equal windows, without hashing."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ids = codes[:n].astype(np.int64)
    for i in range(1, width):
        nxt = codes[i : i + n].astype(np.int64)
        span = int(nxt.max()) + 1
        if int(ids.max() + 1) > (1 << 62) // span:
            ids = np.unique(ids, return_inverse=True)[1]
        ids = ids * span + nxt
    return ids
