"""Classifiers: exact parts by brute force, the rest by held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import langid, quality_model, queries, toxicity

DOCS = "doc_id long, text string, lang string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_just_the_words_within_reach():
    terms = {"idiot": 1, "worthless": 2, "scum": 0, "idol": 0, "worth": 1}
    machine = toxicity.Automaton(dict(terms), frozenset())
    draw = random.Random(0)
    for _ in range(4000):
        word = list(draw.choice(list(terms)))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "x", "i", "o"])
        word = "".join(word)
        near = [(distance(t, word), t) for t, most in terms.items() if distance(t, word) <= most]
        got = machine.find(word)
        assert (got is None) == (not near), word
        if near:
            assert got[1] == min(near)[0]


def test_fold_and_quotes():
    assert [toxicity.fold(w) for w in ("IDIOT!!", "id1ot,", "$tupid", "word$$$", "“scum”", "2024")] == ["idiot", "idiot", "stupid", "word", "scum", "2024"]
    lexicon = toxicity.Lexicon({t: 1.0 for t in toxicity.INSULTS}, frozenset())
    texts = pa.array(["you are an idiot", 'he said "you idiot" again', "they called him an idiot", "nothing here", ""])
    x = toxicity.features(texts, lexicon, lexicon.automaton(), {})
    assert x[0][1] > 0 and x[0][4] == 0 and x[0][8] > 0
    assert x[1][4] > 0 and x[1][1] == 0 and x[2][4] > 0 and x[2][1] == 0
    assert not x[3].any() and not x[4].any()


def test_sum_of_squares_equals_all_pairs():
    draw = np.random.default_rng(1)
    model = quality_model.Machine(0.3, draw.normal(size=40), draw.normal(size=(40, 4)), np.zeros(2), np.ones(2))
    rows, x = np.array([3, 7, 11, 30]), draw.normal(size=4)
    pairs = sum(model.factors[rows[i]] @ model.factors[rows[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert model.margin(rows, x) == pytest.approx(0.3 + model.linear[rows] @ x + pairs)


def test_grams_do_not_depend_on_neighbours():
    texts = ["Añb", "", "x🎉y", "abc def"]
    bins, starts, letters = langid.grams(texts)
    for t, at, n in zip(texts, starts, letters):
        alone, first, count = langid.grams([t])
        assert np.array_equal(bins[:, at : at + len(t)], alone[:, first[0] : first[0] + len(t)]) and n == count[0]
    assert letters.tolist() == [3, 0, 2, 6]


def rows():
    draw = random.Random(4)
    parts = {"en": "the and tion ing er ou sh".split(), "de": "der und ung keit sch ein ö".split(), "fr": "le et que eau tion é oi".split()}
    out = []
    for i in range(400):
        lang = draw.choice(list(parts))
        words = ["".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(5, 80))]
        toxic, bad = draw.random() < 0.2, draw.random() < 0.3
        if toxic:
            words[len(words) // 2] = draw.choice(["idiot", "scum", "iddiot"])
        if bad:
            words = [w + "%%%" for w in words]
        text = " ".join(words)
        out.append((i, text, lang, len(text), int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("classifiers"))
    made = rows()
    docs = [r[:4] for r in made] + [(1000, None, None, None), (1001, "", "en", 0), (1002, "123 456", "en", 7), (None, "the and the ing", "en", 3), (1003, "the ing tion " * 30_000, None, 1)]
    spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("clash"), "label": F.lit(1)}).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(r[0], r[4], r[5]) for r in made[:350]] + [(1001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, {r[0]: r for r in made}


@pytest.mark.parametrize("name,folds,fold,at", [("op5_quality_classifier", 5, 0, 4), ("op10_toxicity", 4, 2, 5)])
def test_scores(spark, tables, name, folds, fold, at):
    base, truth = tables
    got = queries.QUERIES[name](spark, base).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % folds == fold)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]][at] for r in held) >= 0.95 * len(held)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, queries.QUERIES[name](spark, base).collect()), key=str)


def test_languages(spark, tables):
    base, truth = tables
    got = queries.QUERIES["op9_language_id"](spark, base).collect()
    assert len(got) == 405 and {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the idiot", None, 3)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["lang_pred"] for r in langid.identify(docs).collect()] == ["und"]
    assert [r["score"] for r in quality_model.score(docs, quality_model.fit(docs, none)).collect()] == [0.5]
    assert [r["score"] for r in toxicity.score(docs, *toxicity.learn(docs, none)).collect()] == [0.9]
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty).count() == 0
    assert quality_model.score(empty, None).count() == 0


def test_learned_terms_and_stems_are_found_misspelt():
    lexicon = toxicity.Lexicon({"schurke": 0.8, "dreckig": 0.8, "übel": 0.9}, frozenset({"dreckig"}))
    machine = lexicon.automaton()
    words = ("schurke", "schurk", "schrke", "dreckiger", "drekciger", "dreckger", "drckiger", "dreckig", "übe", "haus")
    got = [machine.find(w) for w in words]
    assert got == [("schurke", 0), ("schurke", 1), ("schurke", 1), ("dreckig", 0), None, ("dreckig", 1), ("dreckig", 1), None, None, None]
    x = toxicity.features(pa.array(["du schrke hier", "das drckiger haus", "er sagte schrke"]), lexicon, machine, {})
    assert x[0][9] > 0 and x[1][9] > 0 and not x[2].any() and not x[:, :9].any()


def area(scores, truth):
    """Share of pairs of a toxic and another text that the score orders rightly."""
    pairs = [(a > b) + (a == b) / 2 for a, t in zip(scores, truth) if t for b, u in zip(scores, truth) if not u]
    return sum(pairs) / len(pairs)


def test_edits_and_context_raise_the_held_out_area(spark, monkeypatch):
    """Held-out toxic texts misspell the terms; texts that are not toxic quote them."""
    draw = random.Random(12)
    terms = ["gralmok", "thubrezz", "vindorak", "skalpritt", "mozzelgub", "plontrash"]
    plain = ["".join(draw.choice("aeiou") + draw.choice("bdfglmnprst") for _ in range(draw.randrange(2, 4))) for _ in range(400)]

    def slip(word):
        at = draw.randrange(1, len(word) - 1)
        return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("aeiou") + word[at:], word[:at] + draw.choice("bdfg") + word[at + 1 :]])

    docs, labels = [], []
    for i in range(900):
        held, words, kind = zlib.crc32(str(i).encode()) % 4 == 2, [draw.choice(plain) for _ in range(30)], draw.random()
        toxic = kind < 0.25
        if toxic:
            words[12] = slip(draw.choice(terms)) if held or draw.random() < 0.4 else draw.choice(terms)
        elif kind < 0.33:
            words[12] = '"' + (slip(draw.choice(terms)) if draw.random() < 0.5 else draw.choice(terms)) + '"'
        docs.append((i, " ".join(words), None, 1))
        labels.append((i, 1, int(toxic)))
    docs, table = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2}

    def held_out_area():
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, *toxicity.learn(docs, table)).collect()}
        return area([got[i] for i in truth], list(truth.values()))

    whole = held_out_area()
    with monkeypatch.context() as m:
        m.setattr(toxicity, "edits", lambda term: 0)
        without_edits = held_out_area()
    with monkeypatch.context() as m:
        m.setattr(toxicity, "quoted_words", lambda text, words: frozenset())
        without_context = held_out_area()
    assert whole > 0.95 and without_edits < whole - 0.1 and without_context < whole - 0.02, (whole, without_edits, without_context)


def test_quotations_and_long_words():
    words = ['five', '15"', 'wide', 'idiot', '"an', 'idiot"', 'idiot']
    assert toxicity.quoted_words(' five 15" wide\n idiot "an idiot"\n\nidiot', words) == {4, 5}
    far = ['"a'] + ["b"] * 100 + ['c"']
    assert toxicity.quoted_words(" ".join(far), far) == frozenset()
    lexicon = toxicity.Lexicon({"idiot": 1.0}, frozenset())
    x = toxicity.features(pa.array(["you idiot" + "!" * 90, "x" * 200_000, ""]), lexicon, lexicon.automaton(), {})
    assert x[0].any() and not x[1].any() and not x[2].any()
