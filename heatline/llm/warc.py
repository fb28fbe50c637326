"""WARC archives: writing one record per page, and a splittable reader.

Every record is a gzip member of its own.  The reader deals byte ranges of the
archives to tasks; a task looks for gzip magic in its range, validates each
candidate by decoding it (its text must begin with a WARC header, and the member
must end at another member or at the file's end), and owns the records that start
inside its range, reading past the end for the last one.

Archives lie in the folder all executors share and are opened through
``pyarrow.fs``, so local, HDFS and object-store addresses work alike.  A task
writes under a temporary name and renames when complete, so a lost executor
leaves nothing that a reader takes; the table of finished archives is the manifest.

Null html is an empty payload; a null page_id is written as ``null`` and read
back as null.  A missing address becomes ``urn:page:ID``.  Pages with equal
payloads of at least ``min_bytes`` bytes refer to the one with the smallest
page_id.  Rows that share a page_id are records each for itself.  An empty table
gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive that one reading task scans, and of one read.
RANGE_BYTES, READ_BYTES = 8 << 20, 1 << 18
MANIFEST = "path string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string, start long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", address)
    if address.startswith("/"):
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address)


def _clean(value: str) -> str:
    """``value`` fit for a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; ``refers_to`` makes it a revisit, which keeps the payload's length and digest only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{name}'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def mark_copies(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (smallest page_id with an equal payload, null for that one itself)."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_key", F.sha2("html", 256))
    groups = (
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
        .filter(F.octet_length("html") >= min_bytes)
        .groupBy(F.sha2("html", 256).alias("payload_key"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("payload_key", "first_id")
    )
    groups = tables.stage(groups, "warc_copies")
    return own.join(groups, "payload_key", "left").select("page_id", "url", "html", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in ``folder``, one for each task, and return their manifest (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{place}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        records, sink = 0, None
        for b in batches:
            ids, urls, htmls, refers = (c.to_pylist() for c in b.columns)
            for page_id, url, html, to in zip(ids, urls, htmls, refers, strict=True):
                sink = sink or store.open_output_stream(name + ".open")
                sink.write(record(page_id, url, html.encode(), to))
                records += 1
        if sink:
            size = sink.tell()
            sink.close()
            store.move(name + ".open", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    scheme = "" if folder.startswith(("/", "file:")) else folder.split("://")[0] + "://"
    manifest = mark_copies(tables.small_batches(pages), min_bytes=min_bytes).mapInArrow(run, MANIFEST)
    manifest = tables.stage(manifest, "warc_manifest")
    return manifest.withColumn("path", F.concat(F.lit(scheme), "path")) if scheme else manifest


class _Window:
    """Random reads of one file through a buffer."""

    def __init__(self, source: pa.NativeFile, size: int) -> None:
        self.source, self.size = source, size
        self.at, self.data = 0, b""

    def get(self, start: int, length: int) -> bytes:
        if start < self.at or start + length > self.at + len(self.data):
            self.source.seek(start)
            self.at, self.data = start, self.source.read(min(max(length, READ_BYTES), self.size - start))
        return self.data[start - self.at : start - self.at + length]


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The text of the gzip member at ``start`` and where it ends, or None if it isn't a WARC record's."""
    unpack, parts, at, checked = zlib.decompressobj(31), [], start, 0
    try:
        while not unpack.eof:
            raw = window.get(at, min(READ_BYTES, window.size - at))
            if not raw:
                return None
            parts.append(unpack.decompress(raw))
            at += len(raw)
            if not checked and sum(map(len, parts)) >= 7:
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                checked = 1
    except zlib.error:
        return None
    end = at - len(unpack.unused_data)
    if not checked or end < window.size and window.get(end, 3) != MAGIC:
        return None
    return b"".join(parts), end


def records_in(source: pa.NativeFile, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the records that start in [start, stop)."""
    window, at = _Window(source, size), start
    while at < stop:
        raw = window.get(at, min(READ_BYTES, stop + 2 - at, size - at))
        found = raw.find(MAGIC)
        if found < 0 or at + found >= stop:
            if at + len(raw) >= min(stop, size):
                return
            at += max(1, len(raw) - 2)
            continue
        at += found
        if got := _member(window, at):
            yield at, got[0]
            at = got[1]
        else:
            at += 1


def parse(text: bytes) -> dict:
    """The fields of one record; payload figures come from the payload itself where it is stored."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", fields.get(name, ""))) else None
    revisit = fields["WARC-Type"] == "revisit"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold what its headers state")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": stated,
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload,
    }


def read(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), by byte ranges of ``range_bytes``."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split(" ") for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, place = open_store(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    for at, text in records_in(source, size, start, min(size, start + range_bytes)):
                        row = parse(text) | {"path": path, "start": at}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held >= 2 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    count = max(1, ranges.count())
    return ranges.repartition(min(count, 100_000), "path", "start").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, *, min_bytes: int = 0, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    manifest = write(pages, tables.shared_path(pages.sparkSession, "warc"), min_bytes=min_bytes)
    return read(manifest, range_bytes=range_bytes, payloads=payloads)
