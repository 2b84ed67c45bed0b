"""Legacy archive converter: ARC files (versions 1 and 2) to WARC records.

An ARC record is a header line whose fields depend on the version named by the file's version block, then as many bytes
as the line declares. Each becomes a WARC record with a synthesised id, an ISO timestamp, a type and digests. Records
whose payload was seen before become ``revisit`` records without payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.shared import materialize, new_folder

# The fields of ARC header lines by version, and the profile that marks identical payloads.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
FIELD_LINE = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    block: bytes
    offset: int


def arc_file(version: int, records: list[tuple[str, str, str, str, bytes]], name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records."""
    about = f"{version} 0 legacy\n".encode() + FIELD_LINE[version] + b"\n\n"
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", about, 0, name) + about]
    at = len(out[0])
    for url, ip, date, kind, block in records:
        piece = b"\n" + _arc_line(version, url, ip, date, kind, block, at + 1, name) + block
        out.append(piece)
        at += len(piece)
    return b"".join([*out, b"\n"])


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, block: bytes, offset: int, name: str) -> bytes:
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "-"
    more = f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{more} {len(block)}\n".encode()


def parse_arc(source) -> Iterator[ArcRecord]:
    """Records of an ARC file, bytes or an open uncompressed stream, after its version block; a stream is held record by
    record. Fields are read from the right, so blanks in a URL don't shift them; a line that doesn't fit, or a length
    beyond the end of the file, raises ValueError with the offset."""
    stream, at, version = io.BytesIO(source) if isinstance(source, bytes) else source, 0, None
    while raw := stream.readline():
        start, at = at, at + len(raw)
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            continue
        size = line.rsplit(" ", 1)[-1]
        if version is None and not line.startswith("filedesc://"):
            raise ValueError(f"no version block at {start}")
        parts = line.rsplit(" ", len(FIELDS[version]) - 1) if version else []
        if not raw.endswith(b"\n") or not size.isdecimal() or version and len(parts) < len(FIELDS[version]):
            raise ValueError(f"bad header line at {start}")
        block = stream.read(int(size))
        at += len(block)
        if len(block) < int(size):
            raise ValueError(f"record at {start} declares {size} bytes, more than there are")
        if version is None:
            number = block.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in FIELDS:
                raise ValueError(f"bad version block at {start}")
            continue
        got = dict(zip(FIELDS[version], parts, strict=True))
        yield ArcRecord(got["url"], got["ip"], got["date"], got["type"], block, start)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, url, ip, date, type, block, error) of every record of the ``.arc`` and ``.arc.gz`` files under a path or glob.

    Spark lists the files; each is read as a stream by one task, which holds one record at a time. Where a file breaks off or isn't what it
    says, one row with the ``error`` and the place of the last whole record stands for the rest of it; the other files aren't touched by it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.col("path").rlike(r"\.arc(\.gz)?$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                last = 0
                try:
                    with files.read(name) as raw, (gzip.open(raw) if name.endswith(".gz") else io.BufferedReader(raw)) as stream:
                        for r in parse_arc(stream):
                            last = r.offset
                            yield row(name, r.offset, r.url, r.ip, r.date, r.type, r.block, None)
                except (ValueError, EOFError, zlib.error, gzip.BadGzipFile) as e:
                    yield row(name, last, None, None, None, None, None, f"{type(e).__name__}: {e}")

    names, kinds = zip(("path", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("url", "ip", "date", "type")], ("block", pa.binary()), ("error", pa.string()), strict=True)
    row = lambda *cells: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], names=list(names))
    return found.mapInArrow(run, "path string, offset long, url string, ip string, date string, type string, block binary, error string")


def convert_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, warc, error): the WARC record, as bytes, of each record of the ARC files under a path; null beside an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [None if r["error"] else convert(ArcRecord(r["url"], r["ip"], r["date"], r["type"], r["block"], r["offset"]), place=r["path"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(7)], names=["path", "offset", "warc", "error"])

    return read_arc_files(spark, path).mapInArrow(run, "path string, offset long, warc binary, error string")


def warc_date(date: str) -> str:
    """ISO form of a 14-digit or shorter ARC date. Missing parts are the earliest, and so is what follows the longest beginning that is a
    date (``20200230``: the first of February); 1970 if there is none."""
    digits = date[:14] if date.isascii() and date.isdigit() else ""
    for n in (len(digits), 12, 10, 8, 6, 4):
        if 4 <= n <= len(digits):
            try:
                return f"{datetime.strptime(digits[:n] + '00000101000000'[n:], '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}".rjust(20, "0")
            except ValueError:
                continue
    return "1970-01-01T00:00:00Z"


LOW = (1 << 62) - 1


def record_id(row: int | None, salt: str = "") -> str:
    """URN of a version-8 UUID that holds a 64-bit row number, its two highest bits before the variant's, or of a
    name-based one without."""
    if row is None:
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, salt)}"
    return f"urn:uuid:{uuid.UUID(int=(0x7461 << 112) | (8 << 76) | ((row >> 62 & 3) << 64) | (2 << 62) | (row & LOW))}"


def row_of(urn: str) -> int | None:
    """The row number in a record id."""
    x = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:"))
    if x.version != 8:
        return None
    n = (x.int >> 64 & 3) << 62 | x.int & LOW
    return n - (1 << 64) if n >> 63 else n


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with its blank line, and payload of an HTTP response; a block that isn't one is all payload."""
    if block.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            if (i := block.find(gap)) >= 0:
                return block[: i + len(gap)], block[i + len(gap) :]
    return b"", block


def convert(record: ArcRecord, target: int | None = None, row: int | None = None, place: str = "") -> bytes:
    """The WARC record for an ARC record: response, resource for blocks that aren't HTTP, or revisit if ``target`` is the
    row of another record with the same payload. Its id holds the number ``row``; without one it is named by ``place`` (the
    path of its file), address, date and offset. Nothing in the record itself is taken for a number."""
    head, payload = split_http(record.block)
    digest = hashlib.sha256(payload).digest()
    kind = "revisit" if target is not None else "response" if head else "resource"
    body = head if kind == "revisit" else record.block
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(row, f'{place} {record.url} {record.date} {record.offset}')}>", f"WARC-Date: {warc_date(record.date)}", f"WARC-Target-URI: {record.url}",
        *([f"WARC-IP-Address: {record.ip}"] if record.ip not in ("", "-", "0.0.0.0") else []),
        f"WARC-Payload-Digest: sha256:{digest.hex()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(target)}>"] if kind == "revisit" else []),
        f"Content-Type: {'application/http; msgtype=response' if head else record.type}", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def about_file(name: str) -> bytes:
    """The ``warcinfo`` record that a file begins with."""
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(None, name)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open, uncompressed WARC stream; ValueError where it is cut off."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


def write_archives(pages: DataFrame, folder: str, least: int = 100, file_bytes: int = 64 << 20, broadcast_digests: int = 200_000, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Passes every row through an ARC record and the converter into WARC files, a gzip member per record; returns their
    manifest.

    Equal payloads of ``least`` bytes or more: the smallest key is the response, the others revisit it. Which row that is
    comes from an aggregation over digests. Up to ``broadcast_digests`` repeated ones (counted first) are broadcast, and
    the payloads aren't moved at all; beyond, they are moved once, by digest and key, to meet that answer.
    """
    body = F.encode(F.coalesce(F.col(source), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(source).alias("h"), F.when((F.length(body) >= least) & F.col(key).isNotNull(), F.unhex(F.sha2(body, 256))).alias("digest"))
    slim = rows.where(F.col("digest").isNotNull()).select("k", "digest")
    firsts = slim.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("rows")).where(F.col("rows") > 1).select(F.col("digest").alias("d"), "first")
    firsts = materialize(firsts, "repeated-digests")
    if firsts.count() <= broadcast_digests:
        rows = rows.join(F.broadcast(firsts), F.col("digest") == F.col("d"), "left")
    else:
        again = slim.join(firsts, F.col("digest") == F.col("d")).where(F.col("k") != F.col("first")).select(F.col("k").alias("k2"), "d", "first").distinct()
        rows = rows.join(again, (F.col("k") == F.col("k2")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("k", "u", "h", F.when(F.col("first") != F.col("k"), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt, nth, held, buffer = ctx.partitionId(), f"{ctx.stageId()}-{ctx.taskAttemptId()}", 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held, buffer
            path = f"{folder}/pages-{part:06d}-{nth:06d}.warc.gz"
            files.write(path, [gzip.compress(about_file(path.rsplit("/", 1)[1]), 3, mtime=0), *buffer], attempt)
            nth, held, buffer = nth + 1, 0, []
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, urls, texts, first = (c.to_pylist() for c in batch.slice(a, 256).columns)
                arc = []
                for u, h in zip(urls, texts, strict=True):
                    arc.append((u or "-", "0.0.0.0", "20200101000000", "text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (h or "").encode()))
                # Both versions of the format pass through the converter, by turns.
                for r, i, target in zip(parse_arc(arc_file(1 + (a // 256 + part) % 2, arc)), ids, first, strict=True):
                    # A row without a key is named by its place in this run.
                    buffer.append(gzip.compress(convert(r, target, i, f"{folder} {part} {nth} {len(buffer)}"), 3, mtime=0))
                    held += len(buffer[-1])
                if held >= file_bytes:
                    yield flush()
        if buffer:
            yield flush()

    return rows.mapInArrow(run, "path string")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(row, payload_bytes, payload_digest, record_type, refers_to) of each record of the files that a manifest lists.
    Responses' payloads are measured and digested anew and compared with what the record says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                with files.read(path) as f, gzip.open(f) as stream:
                    for headers, block in read_warc(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        if headers["warc-type"] != "revisit" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        target = headers.get("warc-refers-to")
                        row = row_of(headers["warc-record-id"])
                        out.append((row, size, digest, headers["warc-type"], row_of(target) if target else None))
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 10_000], strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["row", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").mapInArrow(run, "row long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Writes every page to archives in the shared scratch folder and reads them back, one row per page.

    Null and empty html have an empty payload and are responses, as are all payloads under ``least`` bytes. A row with a
    null key is a response that nothing refers to. Of rows that repeat a key with the same payload, each refers to the
    smaller key or is a response. An empty table gives no rows; extra columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    manifest = materialize(write_archives(pages, folder, least, key=key, url=url, source=source), "warc-manifest")
    return read_archives(manifest).withColumnRenamed("row", key)
