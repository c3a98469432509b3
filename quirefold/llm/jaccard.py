"""Exact Jaccard join of shingle sets in metric space, down to components of linked documents.

Two documents link when 100 * |x & y| >= percent * |x | y|; the figures below are those of the default of 85, a
Jaccard distance of 0.15 at most.

Unrelated documents are all at distance 1 from each other and from any pivot, so pivots alone would copy
every document into every region. The join therefore begins with a coarse partition that loses no link, and
pivots divide what is left:

1. Equal sets are one class (by a 64-bit digest); only classes go on.
2. Coarse regions. If x and y link they differ in at most D = 15 (|x| + |y|) / 185 shingles, so of more than D
   hash ranges one holds the same shingles in both. Each class emits signatures of its D + 1 fullest ranges (of 1.5 D,
   so that those all unrelated texts share, with no or one shingle, stay out); signatures with equal
   members count once, and classes with an equal signature are chained into one region unless a lower bound of their
   distance (from counts of shingles in buckets) exceeds what links; so every link lies inside one region.
3. Regions of more than LIMIT classes are divided by pivots: each class goes to the Voronoi cell of its nearest
   pivot p and also to that of each pivot q with d(x, q) - d(x, p) <= 2 * 0.15, since by the triangle
   inequality a linked y at home there satisfies d(x, q) <= d(y, q) + 0.15 <= d(y, p) + 0.15 <= d(x, p) + 0.30.
   Inside a cell a set is carried as its difference from the pivot's, which for near copies is a small part of it:
   |x ^ y| = |(x ^ q) ^ (y ^ q)|. Cells divide again.
4. Cells that stay large are joined block by block. Classes that link with the pivot (its core) are one component
   already and never meet each other; the rest meet the core and each other in shells of distance to the pivot.
5. Cells are joined exactly and emit a spanning forest of their links; components follow from the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import drop_stash, small, stash, text_batches
from .components import connected

#: Words of a shingle, and linked: percent * union <= 100 * intersection. These are the contract of `op8_jaccard_join`;
#: linked_components takes others.
SHINGLE = 4
PERCENT = 85
#: Classes and bytes of sets in a region that one task joins, pivots per division, divisions before blocks.
LIMIT, LIMIT_BYTES, PIVOTS, DEPTH = 2048, 16 << 20, 16, 2
#: Signatures, signature rows with sketches, and bytes of sets that one task gets.
PART_SIGNATURES, PART_ROWS, PART_BYTES = 500_000, 80_000, 6 << 20
#: Larger groups of one signature are chained whole, first in tasks, then over all: they cost time, never links.
LOCAL_GROUP, LARGEST_GROUP = 2048, 8192
#: Least and most buckets of a sketch.
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Rows up to which a lookup table of ids is broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: (from percent, shingles that a bucket of a sketch has at most, step of levels in percent). The lower the limit, the
#: larger the differences that sketches must tell from those of unrelated sets, and the fewer shingles a hash range has.
#: At 16 a bucket, sketches of unrelated sets differ by 0.14 of both sizes or more, and 0.081 is what may link. At 80 % it
#: is 0.111, and 64 buckets of 12 leave 0.16 with a deviation of 0.016 (0.14 and 0.013 once a shorter set of the group
#: halves them), so that groups of thousands chain by chance; 6 a bucket leave 0.22.
PRUNING = ((85, 16, 170), (0, 6, 135))
_ODD = np.uint64(0x9FB21C651E98DF25)
#: Tables that depend on sizes only; plain dictionaries, so that functions that use them travel by value.
_levels: dict[tuple[int, int], tuple[tuple[int, int], ...]] = {}
_bounds: dict[int, np.ndarray] = {}
MOST_CACHED = 4096


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    found = tx.words(pc.ascii_lower(texts))
    hashes = found.hashes()[found.codes] if len(found.codes) else np.empty(0, np.uint64)
    every = tx.rolling(hashes, width)
    for lo, hi in zip(found.starts[:-1], found.starts[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(every[lo : hi - width + 1])
        elif hi > lo:
            yield tx.rolling(hashes[lo:hi], int(hi - lo)) + np.uint64(hi - lo)
        else:
            yield hashes[:0]


def digest(found: np.ndarray) -> int:
    """A signed 64-bit class id of a sorted set."""
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(31))) * _ODD
        total = int(np.add.reduce(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)) ^ (len(found) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return total - (1 << 64) if total >= 1 << 63 else total


def pruning(percent: int) -> tuple[int, int]:
    """Shingles a bucket and step of levels for a limit."""
    return next(p[1:] for p in PRUNING if percent >= p[0])


def _remember(table: dict, key, value):
    if len(table) >= MOST_CACHED:
        table.clear()
    table[key] = value
    return value


def level_of(differences: int, percent: int = PERCENT) -> tuple[int, int]:
    """(most differences of the level, number of hash ranges) for a pair that differs in so many shingles."""
    cap, step = 1, pruning(percent)[1]
    while cap < differences:
        cap = max(cap + 1, cap * step // 100)
    return cap, cap + 1 + (cap + 1) // 2


def levels(size: int, percent: int = PERCENT) -> tuple[tuple[int, int], ...]:
    """Levels at which a set of this size may meet a linked, unequal set."""
    found = _levels.get((size, percent))
    if found is None:
        least, most = -(-percent * size // 100), 100 * size // percent
        differ = lambda other: (100 - percent) * (size + other) // (100 + percent)
        lo, hi = max(1, differ(least)), differ(most)
        out, at = [], lo
        while at <= hi:  # a level at a time
            out.append(level_of(at, percent))
            at = out[-1][0] + 1
        found = _remember(_levels, (size, percent), tuple(out))
    return found


def range_bounds(ranges: int) -> np.ndarray:
    found = _bounds.get(ranges)
    return _remember(_bounds, ranges, np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)) if found is None else found


def signatures(found: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """Signatures of a sorted set, one array for each of its levels.

    Unrelated texts share ranges with no or one shingle by chance, so all but `cap` + 1 ranges stay out, those with the
    fewest shingles first, then by their hash. No link is lost: linked sets agree in at least one range more than stays out,
    and agreeing ranges have one order in both; were the last of them left out by one set, it would leave out all.
    """
    out = []
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(33))) * _ODD
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
        for cap, ranges in levels(len(found), percent):
            at = np.concatenate([[0], np.searchsorted(found, range_bounds(ranges)), [len(found)]])
            signs = sums[at[1:]] - sums[at[:-1]]
            signs = (signs ^ np.uint64(ranges)) * tx._MIX + np.arange(ranges, dtype=np.uint64) * _ODD
            signs = (signs ^ (signs >> np.uint64(30))) * _ODD
            out.append(signs[np.lexsort((signs, np.diff(at)))[ranges - cap - 1 :]])
    return out


def sketch(found: np.ndarray, percent: int = PERCENT) -> bytes:
    """Shingles per bucket, modulo 256; buckets are a power of two and halve by adding neighbours.

    The sum of circular differences of two sketches of one length is at most |x ^ y|.
    """
    bits = (min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-len(found) // pruning(percent)[0]))) - 1).bit_length()
    with np.errstate(over="ignore"):
        bucket = ((found ^ (found >> np.uint64(32))) * _ODD) >> np.uint64(64 - bits)
    return np.bincount(bucket.astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def stack(sketches: list[bytes], buckets: int) -> np.ndarray:
    """Sketches of at least so many buckets as rows of just so many."""
    out = np.empty((len(sketches), buckets), np.uint8)
    lengths = np.fromiter((len(s) for s in sketches), np.int64, len(sketches))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        plain = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8)
        out[at] = plain.reshape(len(at), buckets, length // buckets).sum(axis=2, dtype=np.uint8)
    return out


def _group(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct entries, where groups of one signature begin, and their sizes."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls = sig[new], cls[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(first)
    return sig, cls, starts, np.diff(np.append(starts, len(sig)))


def _chain(cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Edges (class, first class) of the groups marked large."""
    edges = [np.stack([cls[at : at + n], np.full(n, cls[at])], axis=1)[1:] for at, n in zip(starts[large], sizes[large], strict=True)]
    return np.unique(np.concatenate(edges), axis=0) if edges else np.empty((0, 2), np.int64)


#: What reading the texts writes: a row for each document (part is null), and packed signatures or edges by part.
READ = "doc_id long, text_key long, n_shingles long, cls long, sketch binary, part int, signs binary, classes binary, at binary"


def _pack(sig: np.ndarray, cls: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted signatures as six planes of bytes (48 bits tell them apart well enough: a chance meeting costs time, never
    a link), the distinct classes, and each signature's place among those."""
    planes = sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
    classes, at = np.unique(cls, return_inverse=True)
    return planes, classes.astype(np.int64).tobytes(), at.astype(np.uint16 if len(classes) <= 1 << 16 else np.uint32).tobytes()


def _unpack(planes: bytes, classes: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(planes) // 6
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :6] = np.frombuffer(planes, np.uint8).reshape(6, n).T
    return whole.view(">u8").ravel().astype(np.uint64), np.frombuffer(classes, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)]


def read(docs: DataFrame, n_parts: int, width: int, percent: int) -> DataFrame:
    """READ rows: each text is split and hashed once, for its measures, its sketch and its signatures."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")]

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in fields], [c for c, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sig, cls, starts, sizes = _group(np.concatenate(held_sig), np.repeat(np.array(held_cls, np.int64), [len(x) for x in held_sig]))
            large = sizes > LOCAL_GROUP
            edges = _chain(cls, starts, sizes, large)
            keep = np.repeat(~large, sizes)
            keep[starts] = True
            sig, cls = sig[keep], cls[keep]
            part = ((sig >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(sig)]
            rows = [(int(part[lo]), *_pack(sig[lo:hi], cls[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            step = max(1, -(-len(edges) // n_parts))
            rows += [(lo // step, None, edges[lo : lo + step].tobytes(), None) for lo in range(0, len(edges), step)]
            return batch_of(**dict(zip(("part", "signs", "classes", "at"), zip(*rows, strict=True), strict=True)))

        held_sig: list[np.ndarray] = []
        held_cls: list[int] = []
        seen: set[int] = set()
        n = 0
        for batch in batches:
            column = tx.as_strings(batch.column(1))
            for lo, hi in tx.slices(column):
                sizes, classes, sketches = [], [], []
                for found in shingle_sets(column.slice(lo, hi - lo), width):
                    cls = digest(found)
                    sizes.append(len(found))
                    classes.append(cls)
                    sketches.append(sketch(found, percent))
                    if cls in seen or not len(found):
                        continue
                    seen.add(cls)
                    for signs in signatures(found, percent):
                        held_sig.append(signs)
                        held_cls.append(cls)
                        n += len(signs)
                yield batch_of(doc_id=batch.column(0).slice(lo, hi - lo), text_key=batch.column(2).slice(lo, hi - lo), n_shingles=sizes, cls=classes, sketch=sketches)
                if n >= PART_SIGNATURES:
                    yield flush()
                    held_sig, held_cls, n, seen = [], [], 0, set()
        if n:
            yield flush()
        held_sig, held_cls = [], []
        tx.tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).mapInArrow(run, READ)


def text_key(text: Column) -> Column:
    """With doc_id it tells rows apart: rows equal in both are one document said twice."""
    return F.xxhash64(text)


def signed_groups(packed: DataFrame) -> DataFrame:
    """Members (sig, a) of the signatures that several classes have, and edges (a, b) of the groups chained whole.

    Signatures with the same members say the same, so `sig` is a hash of the members and each such group comes once a
    part.
    """

    def meet(table: pa.Table) -> pa.Table:
        whole = table.filter(table["signs"].is_valid())
        unpacked = [_unpack(*row) for row in zip(*(whole[c].to_pylist() for c in ("signs", "classes", "at")), strict=True)]
        edges = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.filter(table["signs"].is_null())["classes"].to_pylist()]
        del whole, table
        sig, cls, starts, sizes = _group(np.concatenate([x for x, _ in unpacked] or [np.empty(0, np.uint64)]), np.concatenate([x for _, x in unpacked] or [np.empty(0, np.int64)]))
        del unpacked
        edges = np.concatenate([*edges, _chain(cls, starts, sizes, sizes > LARGEST_GROUP)])
        several = (sizes > 1) & (sizes <= LARGEST_GROUP)
        cls, sizes = cls[np.repeat(several, sizes)], sizes[several]
        starts = np.cumsum(sizes) - sizes
        names = np.empty(0, np.uint64)
        if len(sizes):
            with np.errstate(over="ignore"):
                mixed = cls.view(np.uint64) * _ODD
                names = (np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * tx._MIX, starts) ^ sizes.astype(np.uint64)) * _ODD
        _, once = np.unique(names, return_index=True)
        keep = np.zeros(len(sizes), bool)
        keep[once] = True
        named, cls = np.repeat(names[keep], sizes[keep]).view(np.int64), cls[np.repeat(keep, sizes)]
        n, m = len(cls), len(edges)
        tx.tidy()
        return pa.table({
            "sig": pa.array(np.concatenate([named, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            "a": np.concatenate([cls, edges[:, 0]]),
            "b": pa.array(np.concatenate([np.zeros(n, np.int64), edges[:, 1]]), mask=np.arange(n + m) < n),
        })

    return packed.select("part", "signs", "classes", "at").groupBy("part").applyInArrow(meet, "sig long, a long, b long")


def _maybe_linked(sizes: np.ndarray, kept: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Can the pairs (i, j) link, by sizes and sketches? Exact in that it never denies a link."""
    a, b = sizes[i], sizes[j]
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    out = np.zeros(len(i), bool)
    near = np.flatnonzero(ok)
    step = max(1, (1 << 24) // kept.shape[1])
    for lo in range(0, len(near), step):
        k = near[lo : lo + step]
        gap = kept[i[k]] - kept[j[k]]
        gap = np.minimum(gap, np.negative(gap)).sum(axis=1, dtype=np.int64)
        out[k] = (100 + percent) * gap <= (100 - percent) * (a[k] + b[k])
    return out


def _near_edges(table: pa.Table, percent: int) -> pa.Table:
    """Edges that chain members of equal signature which may link: rows sig, cls, n, sketch -> a, b."""
    table = table.sort_by("sig")
    sig, every, every_n = (table[c].to_numpy() for c in ("sig", "cls", "n"))
    sketches = table["sketch"].to_pylist()
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    buckets = np.minimum.reduceat(np.fromiter((len(s) for s in sketches), np.int64, len(sketches)), starts)
    edges = []
    for width in np.unique(buckets):  # the sketches of a group are brought to its shortest
        rows = np.flatnonzero(np.repeat(buckets == width, sizes))
        _edges_at(every[rows], every_n[rows], stack([sketches[i] for i in rows], int(width)), sizes[buckets == width], edges, percent)
    found = np.unique(np.concatenate([*edges, np.empty((0, 2), np.int64)]), axis=0)
    del table, sketches
    tx.tidy()
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _edges_at(cls: np.ndarray, n: np.ndarray, kept: np.ndarray, sizes: np.ndarray, edges: list[np.ndarray], percent: int) -> None:
    """Append the edges of adjacent groups of these sizes."""
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes <= 16]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        i, j = (at + i).ravel(), (at + j).ravel()
        ok = _maybe_linked(n, kept, i, j, percent)
        edges.append(np.stack([cls[i[ok]], cls[j[ok]]], axis=1))
    for at, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        # A spanning forest is enough: rows not yet reached are tried from each row reached.
        rest = np.arange(at, at + size)
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                one, front = front[0], front[1:]
                ok = _maybe_linked(n, kept, np.full(len(rest), one), rest, percent)
                edges.append(np.stack([cls[rest[ok]], np.full(ok.sum(), cls[one])], axis=1))
                front, rest = np.concatenate([front, rest[ok]]), rest[~ok]


def chained(packed: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link."""

    def near_edges(table: pa.Table) -> pa.Table:
        return _near_edges(table, percent)

    groups = stash(signed_groups(packed), "groups")
    drop_stash(packed)  # what texts gave is consumed
    members = groups.where("b is null").select("sig", F.col("a").alias("cls"))
    n_parts = max(12, math.ceil(members.count() / (PART_ROWS * pruning(percent)[0] / 16)))
    members = members.distinct().join(owners.select("cls", "n", "sketch"), "cls").withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(n_parts)).cast("int"))
    near = members.select("part", "sig", "cls", "n", "sketch").groupBy("part").applyInArrow(near_edges, "a long, b long")
    edges = stash(near.union(groups.where("b is not null").select("a", "b")), "near")
    drop_stash(groups)
    return edges


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted symmetric difference of two sorted arrays without repeats."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    twice = both[1:] == both[:-1]
    alone = np.ones(len(both), bool)
    alone[1:][twice] = False
    alone[:-1][twice] = False
    return both[alone]


def distance(n_x: int, n_y: int, apart: int) -> float:
    """Jaccard distance of sets of these sizes that differ in so many elements."""
    return 2 * apart / (n_x + n_y + apart) if n_x + n_y else 0.0


def links(n_x: int, n_y: int, apart: int, percent: int) -> bool:
    return (100 + percent) * apart <= (100 - percent) * (n_x + n_y)


def forest(sizes: np.ndarray, carried: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the index of the first set of its component; joins all pairs exactly. Sets of these sizes are
    carried as their differences from one base (or whole: the base is then empty)."""
    n = len(carried)
    lengths = np.array([len(s) for s in carried], np.int64)
    flat, owner = np.concatenate([*carried, np.empty(0, np.uint64)]), np.repeat(np.arange(n), lengths)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(flat)]]))
    # Shingles held by the same documents count together; those of many documents by matrix products.
    shared = np.flatnonzero(counts > 1)
    common = np.zeros((n, n), np.float32)
    if len(shared):
        with np.errstate(over="ignore"):
            tags = (np.arange(1, n + 1, dtype=np.uint64) * _ODD) ^ ((np.arange(1, n + 1, dtype=np.uint64) * tx._MIX) >> np.uint64(21))
            names = np.add.reduceat(tags[owner] * tx._MIX, starts)
        _, one, weight = np.unique(names[shared] ^ counts[shared].astype(np.uint64), return_index=True, return_counts=True)
        lists = shared[one]
        many = counts[lists] > max(8, n // 16)
        for k, w in zip(lists[~many], weight[~many], strict=True):
            held = owner[starts[k] : starts[k] + counts[k]]
            common[np.ix_(held, held)] += np.float32(w)
        lists, weight = lists[many], weight[many]
        for at in range(0, len(lists), 4096):
            held = np.zeros((n, min(4096, len(lists) - at)), np.float32)
            for column, k in enumerate(lists[at : at + 4096]):
                held[owner[starts[k] : starts[k] + counts[k]], column] = 1
            common += (held * weight[at : at + 4096].astype(np.float32)) @ held.T
    linked = np.empty((n, n), bool)
    for lo in range(0, n, 256):  # in strips: the counts of a pair are whole numbers, but products need 64 bits
        apart = lengths[lo : lo + 256, None] + lengths[None, :] - 2 * common[lo : lo + 256].astype(np.int64)
        linked[lo : lo + 256] = (100 + percent) * apart <= (100 - percent) * (sizes[lo : lo + 256, None] + sizes[None, :])
    del common
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            edge = np.array([i])
            while len(edge):
                reach = linked[edge].any(axis=0) & (root < 0)
                root[reach] = i
                edge = np.flatnonzero(reach)
    return root.tolist()


#: A set in a region: n is its size, data its sorted differences from the base of its group (at first: the set itself).
SETS = "group long, cls long, n long, data binary"


def _join_groups(table: pa.Table, percent: int) -> pa.Table:
    """Spanning forests of the links in each group of a part."""
    table = table.sort_by([("group", "ascending"), ("cls", "ascending")])
    groups, cls, sizes = (table[c].to_numpy() for c in ("group", "cls", "n"))
    sets = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
    a, b = [], []
    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])).tolist() + [len(groups)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = cls[lo:hi]
        keep = np.concatenate([[True], own[1:] != own[:-1]])  # a class may come home and as a replica, or from repeated rows
        picked = np.flatnonzero(keep) + lo
        for i, r in zip(picked, forest(sizes[picked], [sets[k] for k in picked], percent), strict=True):
            a.append(int(cls[i]))
            b.append(int(cls[picked[r]]))
    del sets, table
    tx.tidy()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _joined(rows: DataFrame, total_bytes: int, percent: int) -> DataFrame:
    """Exact join inside each group of SETS rows of so many bytes in all."""

    def join_groups(table: pa.Table) -> pa.Table:
        return _join_groups(table, percent)

    n_parts = max(12, math.ceil(total_bytes / PART_BYTES))
    parted = rows.select("group", "cls", "n", "data", F.pmod(F.xxhash64("group", F.lit(7)), F.lit(n_parts)).cast("int").alias("part"))
    return parted.groupBy("part").applyInArrow(join_groups, "a long, b long")


def divide(rows: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """One Voronoi division of SETS rows, whose groups have LIMIT classes or more.

    Returns the SETS rows of the new cells, and those of groups that pivots do not divide (their classes are so near
    each other, or so far, that they would be copied to most cells) with `apart`, the distance to the pivot that most of
    the group link with, and `core`, whether they link with it; None where there are none. Where sets are near their
    cell's pivot they come back as differences from it.
    """
    epsilon = 1 - percent / 100
    # A pivot is the class with the smallest hash in its residue: partial aggregates, no group in one task.
    drawn = rows.select("group", "cls", F.pmod("cls", F.lit(PIVOTS)).alias("residue"), F.xxhash64("cls", F.lit(11)).alias("draw"))
    chosen = drawn.groupBy("group", "residue").agg(F.min_by("cls", "draw").alias("cls"))
    pivots = rows.join(chosen, ["group", "cls"]).dropDuplicates(["group", "cls"]).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cls", "n", "data"))).alias("pivots"))
    pivots = small(stash(pivots, "pivots"), BROADCAST_ROWS, "aggregate(pivots, 0L, (s, p) -> s + octet_length(p.data))")  # PIVOTS sets a group

    def known(batch: pa.RecordBatch, column: int, of: dict) -> list:
        """Per row what `column` holds for the row's group, as made by sets of pivots."""
        out = []
        for i, group in enumerate(batch.column(0).to_pylist()):
            if group not in of:
                if len(of) > 64:
                    of.clear()
                of[group] = [(p["n"], np.frombuffer(p["data"], np.uint64)) for p in batch.column(column)[i].as_py()]
            out.append(of[group])
        return out

    def measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, near, of = [], [], {}
            for own, n, all_pivots in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), known(batch, 4, of), strict=True):
                apart = [(m, len(differences(np.frombuffer(own, np.uint64), p))) for m, p in all_pivots]
                far.append([distance(n, m, d) for m, d in apart])
                near.append([links(n, m, d, percent) for m, d in apart])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.bool_()))], ["group", "cls", "far", "near"])

    reach = F.array_min("far") + 2 * epsilon + 1e-9
    cells = F.filter(F.transform("far", lambda d, q: F.struct(q.alias("q"), d.alias("d"))), lambda c: c["d"] <= reach)
    measured = rows.join(pivots, "group").select("group", "cls", "n", "data", "pivots").mapInArrow(measure_all, "group long, cls long, far array<double>, near array<boolean>")
    measured = stash(measured.withColumn("cells", cells), "distances")
    sizes = stash(measured.select("group", F.explode("cells").alias("c")).groupBy("group", "c.q").agg(F.count("*").alias("n"), F.avg("c.d").alias("d")), "split")
    linked = F.array(*[F.sum(F.coalesce(F.get("near", F.lit(q)), F.lit(False)).cast("int")) for q in range(PIVOTS)])
    whole = measured.groupBy("group").agg(F.count("*").alias("of"), linked.alias("linked"))
    split = whole.join(sizes.groupBy("group").agg(F.sum("n").alias("copies"), F.max("n").alias("most")), "group")
    # Differences are shorter than sets below a distance of 2/3; elsewhere sets stay as they are (q is -1).
    base = F.when(10 * F.array_max("linked") >= F.col("of"), F.array_position("linked", F.array_max("linked")) - 1).otherwise(-1).cast("int")
    split = stash(split.select("group", base.alias("base"), ((F.col("copies") <= 4 * F.col("of")) & (F.col("most") <= 0.7 * F.col("of"))).alias("splits")), "split")
    kinds = {r["splits"] for r in split.select("splits").distinct().collect()}
    measured = measured.join(small(split, BROADCAST_ROWS), "group")

    def rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            data = [differences(x, ps[q][1]).tobytes() if q >= 0 else x.tobytes() for x, ps, q in zip(own, known(batch, 4, {}), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(1), batch.column(2), pa.array(data, pa.binary()), batch.column(7), batch.column(8)], ["group", "cls", "n", "data", "apart", "core"])

    def based(places: DataFrame) -> DataFrame:
        """Rows at (group, cls, q, new, apart, core), with differences from pivot q."""
        at = rows.join(places, ["group", "cls"]).join(pivots, "group").select("group", "cls", "n", "data", "pivots", "q", "new", "apart", "core")
        return at.mapInArrow(rebase, f"{SETS}, apart double, core boolean")

    cell = measured.where("splits").select("group", "cls", F.explode("cells").alias("c"))
    cell = cell.select("group", "cls", "c.q", "c.d").join(small(sizes.select("group", "q", (F.col("d") < 0.5).alias("close")), BROADCAST_ROWS), ["group", "q"])
    new = cell.select("group", "cls", F.when(F.col("close"), F.col("q")).otherwise(-1).cast("int").alias("q"), F.xxhash64("group", "q").alias("new"), F.col("d").alias("apart"), F.lit(False).alias("core"))
    first = F.greatest("base", F.lit(0))
    still = measured.where("not splits").select("group", "cls", F.col("base").alias("q"), F.col("group").alias("new"), F.get("far", first).alias("apart"), ((F.col("base") >= 0) & F.get("near", first)).alias("core"))
    return based(new).select("group", "cls", "n", "data") if True in kinds else None, based(still) if False in kinds else None


def _blocks(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups that stay large, with `apart` and `core`: edges (a, b) that chain each core, and SETS rows of pairs of
    blocks that hold every other pair that may link.

    Two linked classes lie in one shell of distance to the pivot or in neighbouring ones, and the core in shell 0. The
    core is one component, so only pairs with a class of the rest are formed. For each shell, blocks of its own rest
    meet each other and those of the shell above; the core meets the rest of shells 0 and 1.
    """
    shell = F.floor(F.col("apart") / ((1 - percent / 100) * (1 + 1e-6))).cast("int")
    rows = stash(rows.withColumn("shell", F.when(F.col("core"), F.lit(0)).otherwise(shell)), "shells")
    first = rows.where("core").groupBy("group").agg(F.min("cls").alias("b"))
    chain = rows.where("core").join(small(first, BROADCAST_ROWS), "group").select(F.col("cls").alias("a"), "b")

    def blocks(which: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(which) / (LIMIT // 2), F.coalesce(F.sum(F.when(which, F.octet_length("data"))), F.lit(0)) / (LIMIT_BYTES // 2))).cast("int")

    places = rows.select("group", "cls", "n", "data", "core", "shell", F.explode(F.filter(F.array("shell", F.col("shell") - 1), lambda s: s >= 0)).alias("low")).where("not core or low = shell")
    own, above = (F.col("low") == F.col("shell")) & ~F.col("core"), F.col("low") < F.col("shell")
    sizes = stash(places.groupBy("group", "low").agg(blocks(own).alias("k"), blocks(above).alias("u"), blocks(F.col("core")).alias("c")), "blocks")
    at = places.join(small(sizes, BROADCAST_ROWS), ["group", "low"])
    mine = F.when(own, F.col("k")).when(above, F.col("u")).otherwise(F.col("c"))
    at = at.withColumn("i", F.pmod(F.xxhash64("cls", F.lit(5)), mine).cast("int"))
    upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda *c: F.xxhash64("group", "low", *c)
    to_own = F.transform(upto("k"), lambda j: name(F.lit("own"), F.least("i", j), F.greatest("i", j)))
    across = lambda kind, k, mine_first: F.transform(upto(k), lambda j: name(F.lit(kind), *(("i", j) if mine_first else (j, "i"))))
    cells = (
        F.when(own, F.concat(to_own, across("above", "u", True), across("core", "c", True)))
        .when(above, F.concat(across("above", "k", False), across("core above", "c", True)))
        .otherwise(F.concat(across("core", "k", False), across("core above", "u", False)))
    )
    return chain, at.select(F.explode(cells).alias("group"), "cls", "n", "data")


def _roots(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): each class of members(cls, region, key, n) and the class that stands for its component."""
    weights = members.groupBy("region").agg(F.count("*").alias("classes"), (8 * F.sum("n")).alias("bytes"))
    is_large = (F.col("classes") > LIMIT) | (F.col("bytes") > LIMIT_BYTES)
    large = stash(weights.where(is_large).select("region"), "large")
    n_large, total = large.count(), weights.where(~is_large).agg(F.sum("bytes")).collect()[0][0] or 0
    large = small(large, BROADCAST_ROWS)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            column = tx.as_strings(batch.column(2))
            for lo, hi in tx.slices(column):
                want = batch.column(0).slice(lo, hi - lo).to_pylist()
                found = []
                for s, c in zip(shingle_sets(column.slice(lo, hi - lo), width), want, strict=True):
                    found.append(digest(s) == c and c not in seen)  # another row of that id may have another text
                    seen.update([c] if found[-1] else [])
                    want[len(found) - 1] = s if found[-1] else None
                keep, want = pa.array(found), [s for s in want if s is not None]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo).filter(keep) for i in (1, 0)] + [pa.array([len(s) for s in want], pa.int64()), pa.array([s.tobytes() for s in want], pa.binary())], ["group", "cls", "n", "data"])

    def sets_of(some: DataFrame) -> DataFrame:
        # Only rows of documents that stand for a class in some region are read again.
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), "text").join(small(some, BROADCAST_ROWS), "key")
        return texts.select("cls", "region", "text").mapInArrow(sets, SETS)

    done = [stash(_joined(sets_of(members.join(large, "region", "left_anti").select("cls", "region", "key")), total, percent), "forest")]
    if n_large:
        rows = stash(sets_of(members.join(large, "region", "left_semi").select("cls", "region", "key")).dropDuplicates(["cls"]), "sets")
        parts = []
        for depth in range(DEPTH):
            cells, whole = divide(rows, percent)
            if whole is not None:
                chain, pairs = _blocks(whole, percent)
                parts += [chain, _pairs_joined(pairs, percent)]
            if cells is None:
                break
            cells = stash(cells, "cells")
            weights = cells.groupBy("group").agg(F.count("*").alias("classes"), F.sum(F.octet_length("data")).alias("bytes"))
            over = stash(weights.where(is_large).select("group"), "large")
            total, n_over = weights.where(~is_large).agg(F.sum("bytes")).collect()[0][0] or 0, over.count()
            over = small(over, BROADCAST_ROWS)
            parts.append(stash(_joined(cells.join(over, "group", "left_anti"), total, percent), "forest"))
            if not n_over:
                break
            rows = cells.join(over, "group", "left_semi").select("group", "cls", "n", "data")
            if depth == DEPTH - 1:
                # Each row is its cell's: all of it is rest, at one distance.
                _, pairs = _blocks(rows.withColumns({"apart": F.lit(0.0), "core": F.lit(False)}), percent)
                parts.append(_pairs_joined(pairs, percent))
        found = parts[0]
        for more in parts[1:]:
            found = found.union(more)
        done.append(connected(found).select(F.col("node").alias("a"), F.col("root").alias("b")))
    return done[0] if len(done) == 1 else done[0].union(done[1])


def _pairs_joined(pairs: DataFrame, percent: int) -> DataFrame:
    total = pairs.agg(F.sum(F.octet_length("data"))).collect()[0][0] or 0
    return stash(_joined(pairs, total, percent), "forest")


def linked_rows(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, root and component_id of every row, as `linked_components` says; rows share a root
    if links join them, and it is null for the empty set. text_key is text_key() of the text."""
    text_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    share = 0.02 * (100 - percent) / 6  # signatures a byte, about
    found = stash(read(docs, max(12, math.ceil(share * size / PART_SIGNATURES)), width, percent), "read")
    measured = stash(found.where("part is null").select("doc_id", "text_key", "n_shingles", "cls"), "measured")
    one = found.where("n_shingles > 0")
    owners = stash(one.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "owners")
    regions = connected(chained(found.where("part is not null"), owners, percent))  # classes in a region of more than one
    members = regions.withColumnRenamed("node", "cls").join(owners, "cls").select("cls", F.col("root").alias("region"), F.coalesce("doc", F.lit(-(2**63))).alias("key"), "n")
    roots = _roots(docs, stash(members, "members"), width, percent)

    # Smallest id of each class, then of each component.
    named = roots.withColumnRenamed("a", "cls").join(owners, "cls")
    least = named.groupBy("b").agg(F.min("doc").alias("component"))
    twice = lambda rows: rows.withColumn("k", F.xxhash64("b"))  # noqa: E731  (a second key, so that Spark can split the partition of one component)
    grouped = twice(named).join(twice(least), ["b", "k"]).select("cls", F.col("b").alias("root"), "component")
    alone = owners.join(grouped, "cls", "left_anti").select("cls", F.col("cls").alias("root"), F.col("doc").alias("component"))
    component = stash(grouped.union(alone), "component")
    out = measured.where("n_shingles > 0").join(component, "cls").select("doc_id", "text_key", "n_shingles", "root", F.col("component").alias("component_id"))
    return out.union(measured.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long"), "doc_id"))


def linked_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text; other columns are ignored).

    A document's set holds the distinct shingles of `width` words of its whole text; a shorter text is one shingle; a null or
    wordless text has the empty set and links with nothing, so its component is its own id. component_id is the
    smallest doc_id reachable by links, null only where every id in reach is null. Repeated rows and repeated ids each
    give a row. An empty table gives an empty result.
    """
    return linked_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")
