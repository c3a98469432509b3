"""op5 and op9 against models written out plainly: features by loops, all pairs, one weight at a time."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirefold.llm import langid, quality_model, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_fold(doc_id, folds, fold):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(21)
    parts = {"en": "the and ing er sh".split(), "de": "der und ung ö ß".split(), "fr": "le et eau é".split()}
    docs, labels = [], []
    for i in range(90):
        lang = draw.choice(list(parts))
        words = ["".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(3, 25))]
        bad = draw.random() < 0.4
        if bad:
            words = [w + draw.choice(["%", "", "|7"]) for w in words] + words[-1:] * 3
        text = " ".join(w.capitalize() if draw.random() < 0.2 else w for w in words) + draw.choice([".", "\nend", ""])
        docs.append((i, text, lang, len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(90, None, "en", None), (91, "", "en", 0), (92, "12 34", "de", 5), (None, "the und", "de", 7), (None, "the und", "de", 7)]
    labels += [(90, 1, 0), (91, 0, 0), (3, 0, 0), (None, 1, 1), (7, None, None)]
    path = str(tmp_path_factory.mktemp("plain-models"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, labels


def quality_inputs(text, n_chars):
    """{bin: root of the share of its words} and the statistics of one text."""
    text = text or ""
    words, length = WORD.findall(text), max(1, len(text))
    n, bins = max(1, len(words)), {}
    for w in words:
        at = xxhash.xxh64_intdigest(w.lower()) >> 64 - quality_model.BITS
        bins[at] = bins.get(at, 0) + 1 / n
    share = lambda of: math.sqrt(sum(c in of for c in text) / length)
    capitals = math.sqrt(sum("A" <= c <= "Z" for c in text) / length)
    digits = math.sqrt(sum("0" <= c <= "9" for c in text) / length)
    stats = [math.log1p(len(words)), length / n, share("#*$%&|<>"), share("|"), digits, capitals, len(set(words)) / n]
    stats += [sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(text.count("\n")), share(".,;:!?")]
    stats += [max((words.count(w) for w in set(words)), default=0) / n, sum(any(c in "#*$%&|<>" for c in w) for w in words) / n]
    return bins, [*stats, math.log1p(max(0, n_chars or 0))]


def plain_quality(docs, labels):
    """Factorisation machine with every pair written out and AdaGrad one weight at a time."""
    m = quality_model
    label = {}
    for i, q, _ in labels:
        if i is not None and q is not None and not in_fold(i, m.FOLDS, m.FOLD):
            label[i] = max(q, label.get(i, q))
    learn = sorted((i, label[i], *quality_inputs(t, c)) for i, t, _, c in docs if i in label)
    stats = np.array([r[3] for r in learn])
    mean, spread, base = stats.mean(axis=0), stats.std(axis=0) + 1e-3, 1 << m.BITS

    def inputs(bins, values):
        x = {b: math.sqrt(s) * m.WORD_SCALE / 3 for b, s in bins.items()}
        return x | {base + k: max(-5.0, min(5.0, (v - mean[k]) / spread[k])) / 2 for k, v in enumerate(values)}

    share = (sum(r[1] for r in learn) + 0.5) / (len(learn) + 1)
    bias, g_bias = math.log(share / (1 - share)), 1.0
    factors = np.random.default_rng(0).normal(0, 0.02, (base + stats.shape[1], m.RANK))
    linear, g_linear, g_factors = {}, {}, {}

    def margin(x):
        names = list(x)
        pairs = sum(x[a] * x[b] * float(np.dot(factors[a], factors[b])) for k, a in enumerate(names) for b in names[:k])
        return bias + sum(linear.get(a, 0.0) * v for a, v in x.items()) + pairs

    for epoch in range(m.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(learn)):
            x = inputs(*learn[k][2:])
            wrong = sigmoid(margin(x)) - learn[k][1]
            d_linear = {a: wrong * v + m.PENALTY * linear.get(a, 0.0) for a, v in x.items()}
            d_factors = {a: wrong * v * sum(factors[b] * x[b] for b in x if b != a) + m.PENALTY * factors[a] for a, v in x.items()}
            g_bias += wrong * wrong
            bias -= m.RATE * wrong / math.sqrt(g_bias)
            for a in x:
                g_linear[a] = g_linear.get(a, 1e-2) + d_linear[a] ** 2
                g_factors[a] = g_factors.get(a, 1e-2) + d_factors[a] ** 2
                linear[a] = linear.get(a, 0.0) - m.RATE * d_linear[a] / math.sqrt(g_linear[a])
                factors[a] = factors[a] - m.RATE * d_factors[a] / np.sqrt(g_factors[a])
    return [(i, sigmoid(margin(inputs(*quality_inputs(t, c))))) for i, t, _, c in docs]


def test_quality_equals_the_plain_machine(spark, tables, monkeypatch):
    path, docs, labels = tables
    monkeypatch.setattr(quality_model, "EPOCHS", 3)
    got = [(r["doc_id"], r["score"]) for r in queries.op5_quality_classifier(spark, path).collect()]
    want = plain_quality(docs, labels)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=2e-3)
    assert max(s for _, s in got) - min(s for _, s in got) > 0.2


def language_grams(text):
    """{bin: count} over the 1- to 3-grams that begin at each character; two spaces follow the text."""
    m, out = langid, {}
    chars = [ord(c.lower()) if c.isalpha() else 32 for c in text] + [32, 32]
    for at in range(len(text)):
        acc = 0
        for k in range(m.ORDERS):
            acc = ((acc ^ acc >> 15) * m._SALTS[k] + chars[at + k]) % 2**32
            b = acc * 0x27D4EB2F % 2**32 >> 32 - m.BITS
            out[b] = out.get(b, 0) + 1
    return out


def plain_language(docs):
    """Follow-the-regularised-leader one coordinate at a time, then the temperature of least loss on the rows apart."""
    m = langid
    learn = [(i, t, g) for i, t, g, _ in docs if t is not None and g is not None and not in_fold(i, m.FOLDS, m.FOLD)]
    frequency = {}
    for _, t, _ in learn:
        for b in language_grams(t):
            frequency[b] = frequency.get(b, 0) + 1
    idf = lambda b: math.log((1 + len(learn)) / (1 + frequency.get(b, 0))) + 1
    x_of = lambda t: {b: n / max(1, len(t)) * idf(b) * m.SCALE for b, n in language_grams(t).items()}
    once = {(i, t): g for i, t, g in learn if any(c.isalpha() for c in t)}

    def order(row):
        raw = np.array(sorted(language_grams(row[0])), np.int32).tobytes()
        digest = xxhash.xxh64_intdigest(raw, seed=42)
        return (digest - 2**64 if digest >= 2**63 else digest, row[1])

    rows = sorted(((t, g) for (_, t), g in once.items()), key=order)
    langs = sorted({g for _, g in rows})
    apart = [k for k in range(len(rows)) if k % m.CALIBRATE == 0 and len(rows) > 10 * m.CALIBRATE]
    train = [k for k in range(len(rows)) if k not in apart]
    z, squares = {}, {}

    def weight(b, g):
        part, l1 = z.get((b, g), 0.0), 0 if b == "bias" else m.L1
        if abs(part) <= l1:
            return 0.0
        return -(part - math.copysign(l1, part)) / ((m.BETA + math.sqrt(squares.get((b, g), 0.0))) / m.ALPHA + m.L2)

    def margins(x):
        return [sum(weight(b, g) * v for b, v in x.items()) for g in langs]

    def shares(s, temperature):
        e = [math.exp((v - max(s)) / temperature) for v in s]
        return [v / sum(e) for v in e]

    for epoch in range(m.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(train):
            x = x_of(rows[k][0]) | {"bias": 1.0}
            p = shares(margins(x), 1.0)
            old = {(b, g): weight(b, g) for b in x for g in langs}
            for b, v in x.items():
                for g, share in zip(langs, p, strict=True):
                    gradient, before = v * (share - (g == rows[k][1])), squares.get((b, g), 0.0)
                    step = (math.sqrt(before + gradient**2) - math.sqrt(before)) / m.ALPHA
                    z[b, g] = z.get((b, g), 0.0) + gradient - step * old[b, g]
                    squares[b, g] = before + gradient**2
    kept = [(margins(x_of(rows[k][0]) | {"bias": 1.0}), langs.index(rows[k][1])) for k in apart]
    loss = lambda temperature: -sum(math.log(shares(s, temperature)[at]) for s, at in kept)
    temperature = min(np.exp(np.linspace(np.log(0.2), np.log(5), 60)), key=loss) if kept else 1.0
    out = []
    for i, t, _, _ in docs:
        if not t or not any(c.isalpha() for c in t):
            out.append((i, "und", 0.0))
            continue
        p = shares(margins(x_of(t) | {"bias": 1.0}), temperature)
        out.append((i, langs[p.index(max(p))], max(p)))
    return out


def test_language_equals_the_plain_model(spark, tables):
    path, docs, _ = tables
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in queries.op9_language_id(spark, path).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=key), sorted(plain_language(docs), key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=5e-3)


def test_repeated_rows_are_learned_from_once(spark, tables, monkeypatch):
    """One id, or rows without an id, may hold a third of the table: the models stay those of single rows."""
    path, docs, labels = tables
    single = spark.createDataFrame([r for r in docs if r[0] is not None], "doc_id long, text string, lang string, n_chars long")
    marks = spark.read.parquet(f"{path}/labels.parquet")
    often = single.unionByName(single.where("doc_id = 5").crossJoin(spark.range(400)).drop("id"))
    a, b = quality_model.fit(single, marks), quality_model.fit(often, marks)
    assert np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)
    assert toxicity.learn(single, marks)[0] == toxicity.learn(often, marks)[0]
    seen, rows = [], langid._rows
    monkeypatch.setattr(langid, "_rows", lambda docs, idf: seen.append(rows(docs, idf)) or seen[-1])
    for extra in ("doc_id = 5", "doc_id = 6"):
        nameless = single.where(extra).withColumn("doc_id", F.lit(None).cast("long")).crossJoin(spark.range(400)).drop("id")
        langid.fit(single.unionByName(nameless), F.lit(True))
    assert max(t.num_rows for t in seen) <= len(docs)
