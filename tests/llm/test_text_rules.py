"""Compression bands and licence digests."""

import base64
import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from quirefold.llm import compression, licenses
from quirefold.llm import text as tx

DOCS = "doc_id long, text string"


def prose(seed, n):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
    return " ".join(draw.choice(vocabulary) for _ in range(n))


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_measures_and_bands(spark):
    noise = base64.b64encode(random.Random(1).randbytes(6000)).decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    good, phrase = prose(1, 900), [f"{a} {b}" for a in ("alpha", "beta") for b in ("one", "two")]
    pairs = " ".join(random.Random(2).choice(phrase) + f" {i % 7}" for i in range(900))
    rows = [(1, good), (2, noise), (3, pairs), (4, "a b c d e " * 30), (5, "x\n\nx\n x\n\ty\n\ty\nlines and more words to pass the least number"), (6, None), (7, ""), (8, "　é#*$%&|<> " * 3), (9, prose(3, 60_000)), (9, prose(4, 300)), (10, good[:3000] + " " + noise[:5000])]
    got = {(r["doc_id"], r["n_words"]): r for r in compression.quality(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base(text)
        r = got[i, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert [got[i, base(t)[0]]["kept"] for i, t in rows if i in (1, 2, 9, 10)] == [True, False, True, True, False]
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for i, text in rows:
        data, r = (text or "").encode(), got[i, base(text)[0]]
        size = lambda b: len(packer.compress(b)) / len(b)
        ends = sorted({min(len(data), e) for e in range(2000, len(data) + 2000, 2000)}) if len(data) > 2000 else []
        outside = sum(not compression.CHUNK_BAND[0] <= size(data[e - 2000 : e]) <= compression.CHUNK_BAND[1] for e in ends)
        whole = size(data) if data else 1.0
        least, most = [b[1:] for b in compression.BANDS if b[0] <= len(data)][-1]
        assert (r["n_chunks"], r["n_chunks_outside"]) == (len(ends), outside) and abs(r["ratio"] - whole) < 1e-12
        assert r["kept"] == (not base(text)[5] and least <= whole <= most and outside <= compression.CHUNK_SHARE * len(ends))
    assert compression.quality(spark.createDataFrame([], DOCS)).count() == 0


def test_noise_and_repeats_fall_at_every_length_and_prose_stays():
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    keeps = lambda b: compression.verdict(len(b), *compression.ratios(b, packer))
    draw = random.Random(6)
    for n in (220, 320, 420, 600, 900, 1500, 2300, 2999, 9000, 50_000):
        noise = " ".join(base64.b64encode(draw.randbytes(9)).decode() for _ in range(n // 13 + 1))[:n].encode()
        assert not keeps(noise) and not keeps((b"again and again " * (n // 16 + 1))[:n])
        assert keeps(prose(n, n)[:n].encode())
        if 2000 < n < 16_000:
            assert not keeps(prose(n, n)[: n - 1900].encode() + noise[:1900])  # noise in the last piece


def test_window_ids_are_exact():
    draw = np.random.default_rng(0)
    codes = draw.integers(0, 1 << 40, 50)[draw.integers(0, 50, 4000)]
    ids = tx.window_ids(codes, 5)
    tuples = [tuple(codes[i : i + 5]) for i in range(len(codes) - 4)]
    assert len(set(ids.tolist())) == len(set(tuples)) and len({(i, t) for i, t in zip(ids.tolist(), tuples)}) == len(set(tuples))


def test_words():
    texts = ["a\x0bb c d", "", "  ", "\tx\r\n"]
    found = tx.words(pa.array(texts))
    vocab = found.vocab.to_pylist()
    got = [[vocab[k] for k in found.codes[a:b]] for a, b in zip(found.starts[:-1], found.starts[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_long_licences(spark):
    texts = dict(reversed(licenses._files()))  # of each the whole text
    noisy = lambda text: "Copyright 2020 Some One\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", text.upper()).replace("\n", "\n   ").replace(",", " ;")
    rows = [(k, noisy(text)) for k, text in enumerate(texts.values())] + [(k + 100, text + " and more") for k, text in enumerate(texts.values())] + [(200, "word " * 400_000)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(texts) == 13 and [got[k] for k in range(13)] == list(texts) and all(got[k] is None for k in got if k >= 100)


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    noisy = "MIT License\n\nCopyright (c) 2020 Some One\n  (C) 2021 Another\n" + mit.replace("sublicense", "sub-licence").upper().replace(" ", "   ")
    rows = [(1, mit), (2, noisy), (3, mit + " extra"), (4, None), (5, ""), (6, "Copyright me"), (7, "  released UNDER the MIT Licence!!"), (7, "…"), (None, mit)]
    got = [(r["doc_id"], r["license_id"], r["n_chars"]) for r in licenses.scan(spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit(1), "license_id": F.lit(2)})).collect()]
    want = [("1", "MIT"), ("2", "MIT"), ("3", None), ("4", None), ("5", None), ("6", None), ("7", "MIT"), ("7", None), ("None", "MIT")]
    assert sorted((str(i), str(x)) for i, x, _ in got) == sorted((i, str(x)) for i, x in want)
    own = spark.createDataFrame([("B", "some terms"), ("A", "Some, TERMS."), ("C", "")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "some terms"), (2, "")], DOCS)
    for rows_ in (0, 10):
        assert {(r["doc_id"], r["license_id"]) for r in licenses.scan(docs, own, rows_).collect()} == {(1, "A"), (2, None)}
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
