"""WARC records in ZIP packages, read back by byte ranges.

A package is a ZIP file whose members are stored (not deflated): ``archive/data.warc.gz``
(one gzip member per record, back to back), ``indexes/index.cdxj`` (one line per record with
its offset and length inside the archive member) and ``datapackage.json``. Because members
are stored, a record's place in the package is member offset + record offset, and any
record is one range read of the shared file; nothing is extracted.

The reader is its own: end-of-central-directory record, ZIP64 locator and directory,
central entries with ZIP64 extra fields, and each member's local header. Packages are
written by the tasks straight into the shared folder (through ``pyarrow.fs``) under a name
unique to the attempt; the rows a finished task returns name the packages that count, so a
lost executor or a second attempt leaves at most an unnamed file. A package is closed at
``PACKAGE_BYTES``, which bounds what a writer holds.

Revisit records: of records with equal payloads (by SHA-1) the one with the largest key is
the response, the others are revisits that keep its headers, name it and carry no body.
Smaller payloads than ``min_bytes`` are always responses.

Defined cases: a null payload is empty; a null key is written as an empty id, loses against
every other key and reads back null; rows repeating the winner's key are responses too; a
null url has no target header; an empty table gives no package and an empty result.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices

PACKAGE_BYTES = 32_000_000
READ_BYTES = 4_000_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it of a URI or a plain path."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


# ---------------------------------------------------------------- records
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit's block is the HTTP header alone, whose Content-Length
    still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    key: int | None
    kind: str
    url: str | None
    digest: str
    payload_bytes: int
    refers_to: int | None
    payload: bytes | None


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def parse_record(raw: bytes) -> Record:
    """Parse one record and verify its length and, for a response, its payload digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has a wrong length")
    http, _, body = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(body) != digest:
        raise ValueError(f"record {fields.get('warc-record-id')} fails its payload digest")
    size = int(_headers(http)["content-length"])
    return Record(_page(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), digest, size, _page(fields.get("warc-refers-to")), body if kind == "response" else None)


# ---------------------------------------------------------------- ZIP directory
class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header_at: int


ReadAt = Callable[[int, int], bytes]  # (length, offset) -> bytes


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Fill the 32-bit fields that are all ones from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            field = at + 4
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i] = struct.unpack_from("<Q", extra, field)[0]
                    field += 8
        at += 4 + size
    return values


def read_directory(read_at: ReadAt, size: int) -> list[Member]:
    """Members of a ZIP file from its central directory, ZIP64 included."""
    tail_at = max(0, size - 65_557)
    tail = read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        locator_at = tail_at + end - 20
        signature, _, record_at, _ = struct.unpack("<4sIQI", read_at(20, locator_at)) if locator_at >= 0 else (b"", 0, 0, 0)
        if signature == b"PK\x06\x07":
            record = read_at(56, record_at)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, members, pos = read_at(length, at), [], 0
    for _ in range(count):
        f = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, pos)
        if f[0] != b"PK\x01\x02":
            raise ValueError("broken central directory entry")
        name_at = pos + 46
        extra_at = name_at + f[10]
        usize, csize, header_at = _zip64(directory[extra_at:extra_at + f[11]], [f[9], f[8], f[16]])
        name = directory[name_at:extra_at].decode("utf-8" if f[3] & 0x800 else "cp437")
        members.append(Member(name, f[4], f[7], csize, usize, header_at))
        pos = extra_at + f[11] + f[12]
    return members


def stored_offset(read_at: ReadAt, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed inside the package; it can't be range-read")
    head = read_at(30, member.header_at)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"broken local header of {member.name}")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + name + extra


# ---------------------------------------------------------------- writing
def with_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """key, url, payload bytes and the winner of its payload group (null: none needed).

    Groups are found on narrow (digest, key) rows with map-side combining; only digests with
    two or more pages are joined back, so a hot payload is a splittable skewed join key."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col("url").alias("u"), body.alias("p"))
    rows = rows.withColumn("d", F.when(F.octet_length("p") >= min_bytes, F.sha1("p")))
    groups = rows.where("d is not null").groupBy("d").agg(F.max("k").alias("winner"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups.where("n > 1").select("d", "winner"), "d", "left").select("k", "u", "p", "winner")


def write_packages(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every page as a record; returns one row (package, records) per package."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)
        archive, lines = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [ARCHIVE, INDEX], "records": len(lines)}))
                z.writestr(ARCHIVE, archive.getbuffer())
                z.writestr(INDEX, "".join(lines))
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(out.getbuffer())
            row = pa.RecordBatch.from_pylist([{"package": f"{path}/{name}", "records": len(lines)}])
            archive.seek(0)
            archive.truncate()
            lines.clear()
            return row

        for batch in slices(batches, 64):
            for k, url, body, winner in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = winner is not None and k != winner
                raw = gzip.compress(build_record(k, url, body, winner, revisit), mtime=0)
                entry = {"page": k, "offset": archive.tell(), "length": len(raw), "type": "revisit" if revisit else "response"}
                lines.append(f"{'' if k is None else k} {json.dumps(entry)}\n")
                archive.write(raw)
                if archive.tell() >= package_bytes:
                    yield close()
        if lines:
            yield close()

    rows = with_revisits(pages, key, payload, min_bytes)
    return cut_lineage(rows.mapInArrow(write, "package string, records bigint"))


# ---------------------------------------------------------------- reading
def _open(store_cache: dict, package: str) -> tuple[ReadAt, int]:
    if package not in store_cache:
        store_cache.clear()
        store, inside = filesystem(package)
        store_cache[package] = store.open_input_file(inside)
    f = store_cache[package]
    return f.read_at, f.size()


def read_index(packages: DataFrame) -> DataFrame:
    """package, page_id, kind, at and length (bytes in the package) of every record."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for package in batch.column(0).to_pylist():
                read_at, size = _open(files, package)
                members = {m.name: m for m in read_directory(read_at, size)}
                start = stored_offset(read_at, members[ARCHIVE])
                text = read_at(members[INDEX].size, stored_offset(read_at, members[INDEX]))
                if zlib.crc32(text) != members[INDEX].crc:
                    raise ValueError(f"index of {package} fails its checksum")
                found = [json.loads(line.partition(" ")[2]) for line in text.decode().splitlines()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([package] * len(found), pa.string()), pa.array([e["page"] for e in found], pa.int64()), pa.array([e["type"] for e in found], pa.string()),
                    pa.array([start + e["offset"] for e in found], pa.int64()), pa.array([e["length"] for e in found], pa.int64()),
                ], names=["package", "page_id", "kind", "at", "length"])

    return packages.select("package").mapInArrow(index, "package string, page_id bigint, kind string, at bigint, length bigint")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of any rows of ``read_index`` by range reads; neighbouring records are
    fetched by one read of at most about ``READ_BYTES``."""
    schema = "page_id bigint, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def runs(rows: list[tuple]) -> Iterator[list[tuple]]:
        run: list[tuple] = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] != run[-1][1] + run[-1][2] or row[1] + row[2] - run[0][1] > READ_BYTES):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for run in runs(list(zip(*(batch.column(i).to_pylist() for i in range(3))))):
                read_at, _ = _open(files, run[0][0])
                first = run[0][1]
                data = read_at(run[-1][1] + run[-1][2] - first, first)
                got = [parse_record(gzip.decompress(data[at - first:at - first + n])) for _, at, n in run]
                columns = list(zip(*((r.key, r.kind, r.url, r.digest, r.payload_bytes, r.refers_to, r.payload if payloads else None) for r in got)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return index.select("package", "at", "length").mapInArrow(read, schema)
