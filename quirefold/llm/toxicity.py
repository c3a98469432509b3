"""Toxicity: Levenshtein automata over a lexicon trie, and context windows around what they find.

The lexicon is a short list of common insults plus words and word stems that labelled rows show to be toxic. All terms
form one trie; walking it and the Levenshtein automata of its terms together gives a deterministic automaton, built
state by state as words ask for it, that accepts a word within the term's edit distance, or one that begins within a
stem's. Near hits of learned terms are a feature of their own, so their weight is what labelled rows bear out. Each hit is then judged in
its window: between quotation marks of its line or after a reporting verb it is quotation, else abuse. A logistic regression over the
hits of a whole text gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import text as tx
from .common import held_out, text_batches

#: Fixed list: common insults.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "filth", "vermin", "bastard", "bitch", "asshole", "jerk", "creep", "retard", "whore", "slut")
#: Fixed list: verbs that report speech.
REPORTING = ("said", "says", "wrote", "writes", "called", "quoted", "quote", "reported", "claimed", "sagte", "schrieb", "nannte", "zitat", "dijo", "escribió", "llamó", "cita", "dit", "écrit", "appelé", "citation")
#: Fixed map of look-alike characters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

MAX_TRAIN, FOLDS, FOLD, THRESHOLD = 12_000, 4, 2, 0.3
#: Learned terms: most, least toxic texts that hold one, least share of toxic ones; stem lengths.
MAX_TERMS, LEAST_TOXIC, LEAST_SHARE, STEMS = 4000, 4, 0.7, (4, 5, 6, 7)
WINDOW = 6
#: Words between a hit and each of the marks that quote it, at most.
QUOTE_SPAN = 40
#: Trie nodes that the states of an automaton may hold before it starts again.
MOST_HELD = 2_000_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$!") + "“”„«»‘’…–—"
_SPACE = "\x20\t\n\x0b\x0c\r"
_GAP = re.compile(tx.WORD_GAP)
_QUOTES = frozenset("\"“”„«»")
_MARK = re.compile("[" + "".join(sorted(_QUOTES)) + "]")


def edits(term: str) -> int:
    """Edit distance allowed to a term: short ones must be spelled right."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def fold(word: str) -> str:
    """Lower case, without punctuation at the ends; look-alikes count as letters inside a word with letters."""
    word = word.lower().rstrip(_EDGE + "!@$").lstrip(_EDGE + "!")
    if not word.isalpha() and any(c in LOOK_ALIKES for c in word) and any(c.isalpha() for c in word):
        word = "".join(LOOK_ALIKES.get(c, c) for c in word)
    return word


@dataclass
class Automaton:
    """Deterministic automaton of words within the edit distance of trie terms; states appear when first reached."""

    terms: dict[str, int]  # term -> allowed distance
    stems: frozenset[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    reach: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, tuple[str, int]] = field(default_factory=dict)
    states: dict[frozenset, int] = field(default_factory=dict)
    members: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    accepts: list[tuple[str, int] | None] = field(default_factory=list)
    begins: dict[int, tuple[str, int]] = field(default_factory=dict)  # last node of a stem -> (stem, allowed distance)
    prefixes: list[list[tuple[int, str]]] = field(default_factory=list)
    held: int = 0

    def __post_init__(self) -> None:
        near = {s: edits(s) for s in self.stems if edits(s)}  # exact stems are looked up
        for term, most, ends in [*((t, n, self.ends) for t, n in sorted(self.terms.items())), *((t, n, self.begins) for t, n in sorted(near.items()))]:
            node = 0
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            ends[node] = (term, most)
        self._state({(0, 0)})

    def _state(self, now: set[tuple[int, int]]) -> int:
        """The state of (node, edits so far) pairs, closed under letters that the word leaves out."""
        best: dict[int, int] = {}
        todo = sorted(now, key=lambda x: x[1])
        while todo:
            node, used = todo.pop()
            if used > self.reach[node] or best.get(node, 9) <= used:
                continue
            best[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            found = [(used, self.ends[node][0]) for node, used in key if node in self.ends and used <= self.ends[node][1]]
            self.accepts.append(min(found)[::-1] if found else None)
            self.prefixes.append(sorted((used, self.begins[node][0]) for node, used in key if node in self.begins and used <= self.begins[node][1]))
            self.held += len(key)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        following: set[tuple[int, int]] = set()
        for node, used in self.members[state]:
            following.add((node, used + 1))
            if node in self.begins and used <= self.begins[node][1]:
                following.add((node, used))  # whatever follows a stem
            for letter, child in self.children[node].items():
                following.add((child, used + (letter != c)))
        to = self._state({x for x in following if x[1] <= self.reach[x[0]]})
        self.moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of a stem that the word begins with, else of the nearest term or stem."""
        for n in STEMS:
            if word[:n] in self.stems and len(word) > n:
                return word[:n], 0
        if self.held > MOST_HELD:
            for kept in (self.states, self.members, self.moves, self.accepts, self.prefixes):
                kept.clear()
            self.held = 0
            self._state({(0, 0)})
        state = 0
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if not self.members[state]:
                return None
        found = self.accepts[state]
        for used, stem in self.prefixes[state]:
            if len(word) > len(stem):
                return (stem, used) if found is None or used < found[1] else found
        return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    stems: frozenset[str]
    insults: frozenset[str] = frozenset(INSULTS)

    def automaton(self) -> Automaton:
        return Automaton({t: edits(t) for t in self.weights if t not in self.stems}, self.stems)


FEATURES = 10


def quoted_words(text: str, words: list[str]) -> frozenset[int]:
    """Places of the words that stand between two quotation marks of one line, QUOTE_SPAN words from each at most. A mark
    without a partner in its line, as for inches, quotes nothing."""
    out, at = set(), 0
    for line in text.split("\n"):
        n = len(_GAP.sub(" ", line).split(" ")) - (line[:1] in _SPACE) - (line[-1:] in _SPACE) if line.strip(_SPACE) else 0
        marks = [k for k in range(at, at + n) for c in words[k] if c in _QUOTES]
        for first, last in zip(marks[::2], marks[1::2], strict=False):
            out.update(k for k in range(first, last + 1) if k - first <= QUOTE_SPAN and last - k <= QUOTE_SPAN)
        at += n
    return frozenset(out)


def features(texts: pa.Array, lexicon: Lexicon, machine: Automaton, known: dict[str, tuple]) -> np.ndarray:
    """Features of each text of a null-free array, zero without a hit; `known` caches words."""
    found = tx.words(texts)
    if len(known) > 400_000:
        known.clear()
    marks = np.zeros(len(found.vocab), bool)
    hits: dict[int, tuple[str, int]] = {}
    vocab = found.vocab.to_pylist()
    for k, word in enumerate(vocab):
        hit = known.get(word, 0)
        if hit == 0:
            hit = known[word] = machine.find(fold(word))
        if hit is not None:
            marks[k] = True
            hits[k] = hit
    out = np.zeros((len(texts), FEATURES))
    places = np.flatnonzero(marks[found.codes])
    owner = np.searchsorted(found.starts, places, side="right") - 1
    for i in np.unique(owner):
        lo, hi = found.starts[i], found.starts[i + 1]
        codes = found.codes[lo:hi]
        own = places[owner == i] - lo
        text = texts[i].as_py()
        quoted_at = quoted_words(text, [vocab[k] for k in codes]) if _MARK.search(text) else frozenset()
        abuse = quoted = near = exact = guessed = 0.0
        strongest, distinct, address, sure = 0.0, set(), 0, 0
        for at in own:
            term, distance = hits[int(codes[at])]
            weight = lexicon.weights.get(term, 1.0)
            guess = distance > 0 and term not in lexicon.insults
            sure += not guess
            before = [fold(vocab[k]) for k in codes[max(0, at - WINDOW) : at]]
            if int(at) in quoted_at or any(w in REPORTING for w in before):
                quoted += not guess
                continue
            if guess:
                guessed += weight
                continue
            distinct.add(term)
            strongest = max(strongest, weight)
            address += any(w in ("you", "your", "du", "dein", "tú", "tu", "vous", "ton") for w in before)
            if distance:
                near += weight
            elif term in lexicon.insults:
                exact += weight
            else:
                abuse += weight
        out[i] = (float(sure > 0), np.log1p(exact), np.log1p(abuse), np.log1p(near), np.log1p(quoted), np.log1p(len(distinct)), strongest, np.log1p(100 * sure / max(1, hi - lo)), np.log1p(address), np.log1p(guessed))
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights (bias last) by Newton steps with an L2 penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray | None]:
    """Lexicon and score weights from labelled rows outside the held-out fold, about MAX_TRAIN of them at most.

    A document is learned from once: of rows that share an id the largest text counts, of repeated labels the larger, so
    the draw keeps its bound however often rows repeat. Rows without an id have no label. Null and empty texts teach the
    weights of texts without a hit, whole texts count however long, and other columns of both tables are ignored. With
    no label, or no document that has one, the lexicon is the fixed one and there are no weights.
    """
    text_batches(docs.sparkSession)
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))  # of repeated labels the larger counts
    n = rows.count()
    if not n:
        return Lexicon({t: 1.0 for t in INSULTS}, frozenset()), None
    share = int(min(1.0, MAX_TRAIN / n) * 1_000_000) + 1
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share)
    # About MAX_TRAIN rows whatever the table, so the draw may be broadcast. Score weights come from hits of terms that
    # the other half of the draw shows to be toxic, else every learned term would look certain.
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.as_strings(batch.column(0))
            label, half = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in tx.slices(column):
                sums: dict[str, list[int]] = {}
                found = tx.words(column.slice(lo, hi - lo))
                vocab = [fold(w) for w in found.vocab.to_pylist()]
                for i in range(hi - lo):
                    codes = found.codes[found.starts[i] : found.starts[i + 1]]
                    text = column[lo + i].as_py()
                    if _MARK.search(text):  # what is quoted says nothing about a term
                        spelt = found.vocab.take(pa.array(codes)).to_pylist()
                        codes = np.delete(codes, sorted(quoted_words(text, spelt)))
                    own = {vocab[k] for k in np.unique(codes)}
                    own = {w for w in own if len(w) > 3}
                    own |= {w[:k] + "*" for w in own for k in STEMS if len(w) > k}
                    at, toxic = 2 * half[lo + i], bool(label[lo + i])
                    for term in own:
                        sum_of = sums.get(term)
                        if sum_of is None:
                            sum_of = sums[term] = [0, 0, 0, 0]
                        sum_of[at] += 1
                        sum_of[at + 1] += toxic
                # A term without a toxic text here still counts where others have one, so all go out.
                yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), *[pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(4)]], ["term", "n0", "t0", "n1", "t1"])

    sums = joined.select("text", "label", "half").mapInArrow(count, "term string, n0 long, t0 long, n1 long, t1 long")
    counted = Observation()
    sums = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]).observe(counted, F.count(F.lit(1)).alias("n"))
    base = (drawn.agg(F.avg("label")).collect()[0][0]) or 0.0
    least = LEAST_TOXIC
    sure = lambda n, t: (t >= least) & ((t + 2 * base) / (n + 2) >= LEAST_SHARE)
    any_of = sure(F.col("n0"), F.col("t0")) | sure(F.col("n1"), F.col("t1")) | sure(F.col("n0") + F.col("n1"), F.col("t0") + F.col("t1"))
    top = sums.where(any_of).orderBy(F.desc(F.col("t0") + F.col("t1")), "term").limit(MAX_TERMS)  # a lexicon has a size
    rows = [tuple(r) for r in top.collect()]
    # So many toxic texts and no other are no accident among all the terms counted (some 20 may still be).
    chance = math.log(max(2.0, counted.get["n"] / 20)) / -math.log(min(max(base, 1e-3), 0.9))
    least = max(LEAST_TOXIC, math.ceil(chance))

    def lexicon_of(*counts: tuple[str, int, int]) -> Lexicon:
        weights, stems = {t: 1.0 for t in INSULTS}, set()
        for term, n, toxic in sorted(counts, key=lambda x: (len(x[0].rstrip("*")), x[0])):
            word, is_stem = term.rstrip("*"), term.endswith("*")
            said = [word[:k] for k in STEMS if k < len(word) and word[:k] in stems]
            # Too rare, or a shorter stem says it already: for stems one that may be misspelt, else words keep their own edits.
            if not sure(n, toxic) or (any(edits(s) for s in said) if is_stem else said and not edits(word)):
                continue
            if is_stem:
                stems.add(word)
            weights[word] = max(weights.get(word, 0.0), (toxic + 2 * base) / (n + 2) * toxic / (toxic + 4))
        return Lexicon(weights, frozenset(stems))

    halves = (lexicon_of(*[(r[0], r[3], r[4]) for r in rows]), lexicon_of(*[(r[0], r[1], r[2]) for r in rows]))
    lexicon = lexicon_of(*[(r[0], r[1] + r[3], r[2] + r[4]) for r in rows])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, known = [h.automaton() for h in halves], ({}, {})
        for batch in batches:
            half = np.asarray(batch.column(2))
            for k in (0, 1):
                part = batch.filter(pa.array(half == k))
                column = tx.as_strings(part.column(0))
                for lo, hi in tx.slices(column):
                    x = features(column.slice(lo, hi - lo), halves[k], machines[k], known[k])
                    yield pa.RecordBatch.from_arrays([part.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    rest = joined.select("text", "label", "half").mapInArrow(hits, "label int, x binary").toArrow()
    y = rest["label"].to_numpy().astype(float)
    if not len(y):
        return lexicon, None
    x = np.stack([np.frombuffer(b) for b in rest["x"].to_pylist()])
    order = np.lexsort((*x.T, y))
    return lexicon, logistic(x[order], y[order])


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic 1 likelier) and n_hits of every row.

    Null and empty texts have no hits and get the score of such texts. Without anything learned the score is 0.9 with
    abuse and 0.05 without. Repeated rows get a row each, an empty table an empty result; texts count whole, however
    long. Other columns are ignored.
    """

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = lexicon.automaton(), {}
        for batch in batches:
            column = tx.as_strings(batch.column(1))
            for lo, hi in tx.slices(column):
                x = features(column.slice(lo, hi - lo), lexicon, machine, known)
                if weights is None:
                    p = np.where(x[:, 5] > 0, 0.9, 0.05)
                else:
                    p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
