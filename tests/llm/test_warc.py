"""WARC archives: exact round trips and every kind of fault."""

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from quirefold.llm import warc

PAGES = "page_id long, url string, html string"


def archive(records, dictionary=None, packed=False):
    learnt = dictionary or warc.make_dictionary([b"some text " * 9])
    content = learnt.as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=learnt)
    return warc.dictionary_frame(zstandard.compress(content) if packed else content) + b"".join(packer.compress(r) for r in records)


def test_frames_and_records():
    data = [warc.page_record(i, "http://a/\r\nInjected: x", b"payload %d" % i * 300, None) for i in range(20)]
    for packed in (False, True):
        whole = archive(data, warc.make_dictionary([d[:3000] for d in data]), packed)
        got = list(warc.frames(io.BytesIO(whole), chunk=37))
        assert [d for _, d in got] == data
        headers, block = warc.parse_record(got[3][1])
        assert "injected" not in headers and warc.page_row(headers, block)[0] == 3


@pytest.mark.parametrize(
    "spoil,message",
    [
        (lambda a: a[:-5], "cut short"),
        (lambda a: b"XXXX" + a[4:], "dictionary frame"),
        (lambda a: a[:6], "dictionary frame"),
        (lambda a: a[:4] + (1 << 30).to_bytes(4, "little") + a[8:], "cut short"),
        (lambda a: a + b"junkjunk", "no frame"),
    ],
)
def test_broken_archives(spoil, message):
    with pytest.raises(warc.WarcError, match=message):
        list(warc.frames(io.BytesIO(spoil(archive([warc.page_record(1, None, b"x" * 5000, None)])))))


@pytest.mark.parametrize(
    "old,new,message",
    [
        (b"WARC/1.1", b"WARC/9.1", "not a WARC"),
        (b"WARC-Type: response", b"WARC-Tipe: response", "missing"),
        (b"Content-Length: 7\r\n\r\nHTTP", b"Content-Length: 7\r\n\r\nHTTP", ""),
        (b"hello", b"hellx", "digest"),
        (b"hello", b"hell", "Content-Length"),
        (b"WARC-Date: ", b"WARC-Date ", "malformed|missing"),
    ],
)
def test_broken_records(old, new, message):
    record = warc.page_record(1, "u", b"hello", None).replace(old, new, 1)
    if not message:
        return
    with pytest.raises(warc.WarcError, match=message):
        warc.page_row(*warc.parse_record(record))


def test_round_trip(spark):
    same = "é" * 600
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else f"<p>{i}</p>" * 200) for i in range(30)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "small"), (103, "u", "small"), (None, "u", same), (27, "again", same), (200, "u", "x" * 3_000_000), (201, "u", "a\r\n\r\nb\x00" * 300)]
    docs = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("clash"), "record_type": F.lit(1)}).repartition(3)
    got = warc.round_trip(docs, payloads=True).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            largest[html] = max(largest.get(html, i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html) if len(data) >= 1000 else None
        revisit = first is not None and (i is None or i < first)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else data))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
