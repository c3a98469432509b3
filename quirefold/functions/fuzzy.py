"""Fuzzy text similarity: Indel ratios and near matches, as Arrow functions behind native shortcuts.

Ratios are 100 times the normalised Indel similarity, 200 * LCS / (len a + len b).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Titles up to so many characters need so much similarity; longer ones need the last.
THRESHOLDS = ((2, 95), (4, 85), (8, 75))
LONG_THRESHOLD, TOKEN_EASING, SHORT_TITLE = 65, 10, 4


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel columns, a machine word per Python integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of its length in the longer, windows cut by the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return float(partial_ratios([a], [b])[0])


#: Characters that fit the bits of a word; windows that are looked at together.
WORD_BITS, WINDOWS = 64, 1 << 15
#: Pairs of a batch that are laid out together.
PAIRS_AT_ONCE = 512


def partial_ratios(shorter: list[str], longer: list[str]) -> np.ndarray:
    """partial_ratio of pairs in which the shorter text is not empty; one shorter text stands for all.

    Pairs whose shorter texts have one length are laid out in one row of letters, and the bit-parallel columns of all
    their windows advance together. A shorter text beyond a word's bits goes by itself.
    """
    if len(shorter) == 1:
        groups = {len(shorter[0]): range(len(longer))}
    else:
        groups = {}
        for k, a in enumerate(shorter):
            groups.setdefault(len(a), []).append(k)
    best = np.zeros(len(longer))
    for n, members in groups.items():
        texts = [longer[k] for k in members]
        if n > WORD_BITS:
            best[members] = [_long_partial_ratio(shorter[k if len(shorter) > 1 else 0], b) for k, b in zip(members, texts, strict=True)]
        else:
            best[members] = _windows(n, shorter if len(shorter) == 1 else [shorter[k] for k in members], texts)
    return best


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _windows(n: int, shorter: list[str], longer: list[str]) -> np.ndarray:
    """partial_ratio of texts of n characters with longer ones (one for all, or one for each)."""
    sizes = np.array([len(b) for b in longer])
    codes = _letters(longer)
    if len(shorter) == 1:
        masks: dict[int, int] = {}
        for i, c in enumerate(shorter[0]):
            masks[ord(c)] = masks.get(ord(c), 0) | (1 << i)
        known = np.array(sorted(masks), dtype=np.uint32)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hits = np.where(known[at] == codes, np.array([masks[c] for c in known.tolist()], dtype=np.uint64)[at], np.uint64(0))
    else:
        mine, of = _letters(shorter).reshape(-1, n), np.repeat(np.arange(len(longer)), sizes)
        hits = np.zeros(len(codes), dtype=np.uint64)
        for i in range(n):
            hits |= (mine[of, i] == codes).astype(np.uint64) << np.uint64(i)
    # Each text has n - 1 empty places on both sides, shared with its neighbours: a window starts at every place.
    starts = np.concatenate([[0], np.cumsum(sizes + n - 1)])
    row = np.zeros(starts[-1] + n - 1, dtype=np.uint64)
    row[np.arange(len(codes)) + np.repeat((n - 1) * np.arange(1, len(longer) + 1), sizes)] = hits
    end = np.arange(1, starts[-1] + 1) - np.repeat(starts[:-1], sizes + n - 1)
    width = np.minimum(end, np.repeat(sizes, sizes + n - 1)) - np.maximum(0, end - n)
    ratios = np.empty(starts[-1])
    full = np.uint64((1 << n) - 1)
    for lo in range(0, len(ratios), WINDOWS):
        hi = min(lo + WINDOWS, len(ratios))
        state = np.full(hi - lo, full)
        hit, up = np.empty_like(state), np.empty_like(state)
        for t in range(n):
            np.bitwise_and(state, row[lo + t : hi + t], out=hit)
            np.add(state, hit, out=up)
            np.subtract(state, hit, out=state)
            np.bitwise_or(state, up, out=state)
        ratios[lo:hi] = 200.0 * (n - np.bitwise_count(state & full).astype(np.int64)) / (n + width[lo:hi])
    return np.maximum.reduceat(ratios, starts[:-1])


def _long_partial_ratio(a: str, b: str) -> float:
    n, best = len(a), 0.0
    for end in range(1, len(b) + n):
        best = max(best, ratio(a, b[max(0, end - n) : min(end, len(b))]))
        if best == 100.0:
            break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def threshold(title: str) -> int:
    return next((t for n, t in THRESHOLDS if len(title) <= n), LONG_THRESHOLD)


def title_matches(title: str | None, element: str | None) -> bool:
    """Does the element's text hold the title, exactly or nearly? Short titles need closer matches."""
    return first_match(title, [element]) is not None


#: Texts that a search takes together: so many at first, twice as many each time, up to so many or so many characters.
FIRST_TEXTS, MOST_TEXTS, MOST_LETTERS = 8, 256, 1 << 15


def first_match(title: str | None, elements: list[str | None], at: int = 0, normal: list[str] | None = None) -> int | None:
    """Index of the first element from `at` on that holds the title, exactly or nearly; normal: the elements' texts with
    single spaces, where the caller has them. Texts before the nearest exact hit are compared in batches."""
    if not title:
        return None
    a, take = " ".join(title.split()), FIRST_TEXTS
    bare = [title.translate({ord("（"): None, ord("）"): None}), title.translate({ord("（"): "(", ord("）"): ")"})] if "（" in title and "）" in title else []
    while at < len(elements):
        tried, letters, exact = [], 0, None
        while at < len(elements) and len(tried) < take and letters < MOST_LETTERS:
            element = elements[at]
            if element:
                b = " ".join(element.split()) if normal is None else normal[at]
                if a in b or any(t in element for t in bare):
                    exact = at
                    break
                tried.append((at, b))
                letters += len(b)
            at += 1
        near = _first_near_title(a, tried)
        if near is not None or exact is not None:
            return exact if near is None else near
        take = min(2 * take, MOST_TEXTS)
    return None


def _first_near_title(a: str, tried: list[tuple[int, str]]) -> int | None:
    """The first of (index, text) that nearly holds a; both have single spaces."""
    least, n = threshold(a), len(a)
    windowed = [b for _, b in tried if len(b) >= n]
    best = iter(partial_ratios([a], windowed)) if windowed else iter(())
    for i, b in tried:
        partial = next(best) if len(b) >= n else partial_ratio(a, b)
        if partial >= least:
            return i
        reach = 200.0 * min(n, len(b)) / (n + len(b))  # no ratio of the two is higher
        if reach >= least and ratio(a, b) >= least:
            return i
        if n <= SHORT_TITLE:
            if any(ratio(a, w) >= least for w in set(re.findall(r"[一-鿿]+|[a-zA-Z]+", b)) if 200.0 * min(n, len(w)) / (n + len(w)) >= least):
                return i
        elif reach >= least - TOKEN_EASING and token_sort_ratio(a, b) >= least - TOKEN_EASING:
            return i
    return None


def near_sequence(text: str, keywords: list[str], most: int = 3) -> list[tuple[int, int]]:
    """(start, end) of each keyword's first near match (edit distance `most` at most) after the one before; [] if one is missing."""
    found, at = [], 0
    for word in keywords:
        hit = first_near(text[at:], word, most)
        if hit is None:
            return []
        found.append((at + hit[0], at + hit[1]))
        at += hit[1]
    return found


def first_near(text: str, word: str, most: int) -> tuple[int, int] | None:
    """First substring within the edit distance, the nearest one that ends while the distance still falls."""
    cost, start = list(range(len(word) + 1)), [0] * (len(word) + 1)
    best: tuple[int, int, int] | None = None
    for j, c in enumerate(text, 1):
        above, above_start = cost[0], start[0]
        start[0] = j
        for i, w in enumerate(word, 1):
            choices = ((above + (c != w), above_start), (cost[i] + 1, start[i]), (cost[i - 1] + 1, start[i - 1]))
            above, above_start = cost[i], start[i]
            cost[i], start[i] = min(choices, key=lambda x: x[0])
        if cost[-1] <= most and (best is None or cost[-1] < best[0]):
            best = (cost[-1], start[-1], j)
        elif best is not None:
            break
    return best[1:] if best else None


def _each_pair(f, a: pd.Series, b: pd.Series, missing=None) -> list:
    """f of each pair of a batch, once where pairs repeat; `missing` where either is null."""
    known: dict[tuple, object] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(missing)
            continue
        if pair not in known:
            known[pair] = f(*pair)
        out.append(known[pair])
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each_pair(ratio, a, b), dtype="float64")


@F.pandas_udf(T.DoubleType())
def indel_partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list({(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True) if x and y})
    best: dict[tuple, float] = {}
    for lo in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[lo : lo + PAIRS_AT_ONCE]
        shorter, longer = [p[0] for p in some], [p[1] for p in some]
        best |= zip(some, partial_ratios(shorter, longer).tolist(), strict=True)
    look = lambda x, y: best[(x, y) if len(x) <= len(y) else (y, x)] if x and y else partial_ratio(x, y)
    return pd.Series(_each_pair(look, a, b), dtype="float64")


@F.pandas_udf(T.DoubleType())
def indel_token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each_pair(token_sort_ratio, a, b), dtype="float64")


@F.pandas_udf(T.BooleanType())
def _near_title(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each_pair(title_matches, a, b, False), dtype="bool")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def near_spans(text: pd.Series, keywords: pd.Series) -> pd.Series:
    words = [None if k is None else tuple(k) for k in keywords]
    return pd.Series([[{"start": s, "end": e} for s, e in found] for found in _each_pair(lambda t, k: near_sequence(t, list(k)), text, words, [])])


def fuzzy_title(title: Column, element: Column) -> Column:
    """title_matches as a column: exact containment is decided natively; only the rest goes to Python."""
    exact = F.coalesce((title != "") & element.contains(title), F.lit(False))
    return exact | F.coalesce(_near_title(F.when(~exact, title), F.when(~exact, element)), F.lit(False))
