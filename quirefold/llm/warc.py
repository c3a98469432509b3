"""WARC archives in Zstandard: writer and reader (one frame per record, shared dictionary).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself a Zstandard
frame; each record is a frame of its own, compressed with it. Archives are written by the tasks that hold the pages, to
the shared folder through a file system that workers can open themselves; a manifest table lists them, so only archives
of tasks that Spark committed are read, whatever was retried. Readers stream an archive frame by
frame. Workers open the folder with `pyarrow.fs` (file, s3, gs, and hdfs where libhdfs is installed).
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import fresh_path, small, stash, text_batches

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: An archive is closed at this size; dictionaries take this many bytes from so many bytes of the first payloads.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 256 << 20, 64 << 10, 4 << 20
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record breaks the format."""


def dictionary_frame(content: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def make_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where there is enough to learn from; else the samples themselves, as raw content."""
    whole = b"".join(samples)
    if len(samples) >= 16 and len(whole) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, len(whole) // 4), samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(whole[-DICTIONARY_BYTES:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record_bytes(kind: str, record_id: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    lines += [f"{k}: {re.sub(r'[\r\n]+', '%0A', v)}" for k, v in headers.items()]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises WarcError on any fault."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record headers do not end")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    missing = [name for name in MANDATORY if name not in headers]
    if missing:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdecimal():
        raise WarcError("Content-Length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the record holds {len(rest) - 4}")
    block = rest[:length]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
        raise WarcError("block digest does not match")
    return headers, block


def frames(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each frame after the dictionary; one frame in memory at a time."""
    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise WarcError("the archive does not begin with a dictionary frame")
    size = int.from_bytes(head[4:], "little")
    content = stream.read(size)
    if len(content) != size:
        raise WarcError("the dictionary frame is cut short")
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompress(content)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    at, data = 8 + size, b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        while len(data) < 4 and (more := stream.read(chunk)):
            data += more
        if data[:4] != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one, parts, used = decoder.decompressobj(), [], 0
        while True:
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as wrong:
                raise WarcError(f"frame at byte {at}: {wrong}") from wrong
            used += len(data) - len(one.unused_data)
            if one.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise WarcError(f"the frame at byte {at} is cut short")
        yield at, b"".join(parts)
        at, data = at + used, one.unused_data


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: an HTTP response, or a revisit without payload that names the page that has it."""
    headers = {"WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}", "X-Payload-Length": str(len(payload))}
    if url is not None:
        headers["WARC-Target-URI"] = url
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    headers["Content-Type"] = "application/http;msgtype=response"
    if refers_to is None:
        return record_bytes("response", f"urn:page:{page_id}", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record_bytes("revisit", f"urn:page:{page_id}", headers, http)


def page_row(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record, checked."""

    def number(value: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+|None)>", value)
        if not found:
            raise WarcError(f"not a page: {value[:80]!r}")
        return None if found[1] == "None" else int(found[1])

    kind = headers["warc-type"]
    digest, length = headers.get("warc-payload-digest", ""), headers.get("x-payload-length", "")
    if not re.fullmatch(r"sha1:[0-9a-f]{40}", digest) or not length.isdecimal():
        raise WarcError("payload digest or length is missing")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP message")
    if kind == "response":
        if len(payload) != int(length) or hashlib.sha1(payload).hexdigest() != digest[5:]:
            raise WarcError("payload does not match its digest and length")
        return number(headers["warc-record-id"]), headers.get("warc-target-uri"), len(payload), digest[5:], kind, None, payload
    if kind != "revisit" or payload:
        raise WarcError(f"unexpected record of type {kind}")
    return number(headers["warc-record-id"]), headers.get("warc-target-uri"), int(length), digest[5:], kind, number(headers.get("warc-refers-to", "")), None


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of the shared folder, as a worker sees them (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows of pages(page_id, url, html) as archives below `folder`; the manifest: archive, records.

    Each task rolls over to a new archive at ARCHIVE_BYTES. Names are unique to the attempt; the manifest is written by
    Spark's committer, so archives that a lost attempt left behind are in no manifest.
    """
    spark = pages.sparkSession
    text_batches(spark)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    # Only digests that repeat come back, one row each; counting them is a partial aggregate.
    repeated = pages.where(size >= LEAST_REVISIT).select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_page"))
    repeated = stash(repeated.where("n > 1").select("digest", "first_page"), "repeated")
    # Pages that match nothing get keys of their own, so a shuffle join would not gather them.
    own = F.concat(F.lit("page "), F.coalesce(F.col("page_id"), F.lit(0)).cast("string"))
    marked = pages.select("page_id", "url", "html").withColumn("digest", F.when(size >= LEAST_REVISIT, digest).otherwise(own))
    marked = marked.join(small(repeated), "digest", "left")  # 60 bytes a row
    refers = F.when(F.col("page_id") < F.col("first_page"), F.col("first_page")).when(F.col("page_id").isNull(), F.col("first_page"))
    rows = marked.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", refers.cast("long").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(folder)
        filesystem.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        waiting: list[tuple] = []
        archive = None

        def put(records: list[tuple]) -> None:
            nonlocal archive
            for page_id, url, payload, refers_to in records:
                if archive is None:
                    samples, total = [], 0
                    for other in records:
                        samples.append(other[2][:32_768])
                        total += len(samples[-1])
                        if total >= SAMPLE_BYTES:
                            break
                    learnt = make_dictionary([s for s in samples if s])
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    archive = [name, filesystem.open_output_stream(posixpath.join(base, name)), zstandard.ZstdCompressor(level=3, dict_data=learnt), 0, 0]
                    archive[1].write(dictionary_frame(learnt.as_bytes()))
                data = archive[2].compress(page_record(page_id, url, payload, refers_to))
                archive[1].write(data)
                archive[3] += 1
                archive[4] += len(data)
                if archive[4] >= ARCHIVE_BYTES:
                    close()

        def close() -> None:
            nonlocal archive
            if archive:
                archive[1].close()
                done.append((archive[0], archive[3]))
                archive = None

        held = 0
        for batch in batches:
            html = tx.as_strings(batch.column(2)).cast(pa.binary())
            for i in range(batch.num_rows):
                payload = html[i].as_py()
                waiting.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), payload, batch.column(3)[i].as_py()))
                held += len(payload)
                if held >= SAMPLE_BYTES:
                    put(waiting)
                    waiting, held = [], 0
        put(waiting)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    path = f"{folder}/manifest"
    rows.mapInArrow(write, "archive string, records long").write.parquet(path)
    return spark.read.schema("archive string, records long").parquet(path)


def read_pages(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives: archive, offset, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, where wanted, payload. A fault in an archive fails the job (WarcError), naming archive and byte."""
    columns = {"archive": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = list(columns)[: None if payloads else -1]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], columns[n]) for i, n in enumerate(names)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(folder)
        for part in batches:
            for name, expected in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with filesystem.open_input_stream(posixpath.join(base, name)) as stream:
                    try:
                        for at, data in frames(stream):
                            rows.append((name, at, *page_row(*parse_record(data))))
                            seen += 1
                            held += len(data) if payloads else 200
                            if held >= 8 << 20:
                                yield batch(rows)
                                rows, held = [], 0
                    except WarcError as wrong:
                        raise WarcError(f"{name}: {wrong}") from wrong
                if seen != expected:
                    raise WarcError(f"{name}: {seen} records, the manifest says {expected}")
                yield batch(rows)

    kinds = {"archive": "string", "offset": "long", "page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    n = max(1, manifest.count())
    return manifest.repartition(min(n, 10_000)).mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in names))


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, those with the largest page_id are responses (rows that
    repeat it too) and the others, null ids included, are revisits of it; where all ids are null all are responses. Null
    html is the empty payload, a null url is left out, line breaks in a url are escaped. No pages, no records. Other
    columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_pages(write_pages(pages, folder), folder, payloads)
