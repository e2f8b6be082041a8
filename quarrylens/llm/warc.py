"""WARC archives in ZIP packages: written by partition, read back by byte ranges without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (a gzip member per record), ``indexes/index.cdxj``
(a line per record with its offset and length) and ``datapackage.json``. The reader finds the end-of-central-directory
record, follows the ZIP64 locator where sizes or counts don't fit, lists the members from the central directory, takes
the data position of a stored member from its local header, and reads single records by range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, store

DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
LEAST_REVISIT = 1000
PACKAGE_BYTES = 24 << 20
HEAVY_PARTS = 1000
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# --- reading ZIP packages -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def _read_at(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def central_directory(file, total: int) -> list[Member]:
    """Members listed in the central directory, plain or ZIP64. Raises ValueError where there is none."""
    tail_at = max(0, total - 65_557)
    tail = _read_at(file, tail_at, total - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    entries, size, offset = struct.unpack("<H2L", tail[at + 10 : at + 20])
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF or tail[at - 20 : at - 16] == _LOCATOR64 and at >= 20:
        locator = _read_at(file, tail_at + at - 20, 20)
        if locator[:4] == _LOCATOR64:
            record = _read_at(file, struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != _END64:
                raise ValueError("bad ZIP64 end of central directory")
            entries, size, offset = struct.unpack("<3Q", record[32:56])
    data, members, p = _read_at(file, offset, size), [], 0
    for _ in range(entries):
        if data[p : p + 4] != _CENTRAL:
            raise ValueError("bad central directory entry")
        method = struct.unpack("<H", data[p + 10 : p + 12])[0]
        packed, full, n_name, n_extra, n_note = struct.unpack("<2L3H", data[p + 20 : p + 34])
        header = struct.unpack("<L", data[p + 42 : p + 46])[0]
        name = data[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, e = data[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack("<2H", extra[e : e + 4])
            if kind == 1:
                wide = list(struct.unpack(f"<{length // 8}Q", extra[e + 4 : e + 4 + length // 8 * 8]))
                if full == 0xFFFFFFFF and wide:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF and wide:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF and wide:
                    header = wide.pop(0)
            e += 4 + length
        members.append(Member(name, method, full, packed, header))
        p += 46 + n_name + n_extra + n_note
    return members


def data_position(file, member: Member) -> int:
    """Where the bytes of a stored member begin; ValueError for a compressed one, which has no ranges."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    header = _read_at(file, member.header, 30)
    if header[:4] != _LOCAL:
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack("<2H", header[26:30])
    return member.header + 30 + n_name + n_extra


# --- WARC records ---------------------------------------------------------------------------------------------------


def _line(value: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value or "")


def record_bytes(page: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 response, or revisit of ``refers_to``, as a gzip member. A revisit keeps the HTTP header without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(packed: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one gzip member; ValueError if lengths don't agree."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length doesn't agree with its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


# --- packages by Spark ----------------------------------------------------------------------------------------------


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write records (page_id, url, html, sha1, refers_to as text) as packages under ``folder``; returns their paths.

    Each task writes under a name of its own attempt and renames it to its partition's, so a task that runs again
    replaces what a lost executor left.
    """
    small_batches(records.sparkSession)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, (store_fs, root) = TaskContext.get(), open_folder(folder)
        store_fs.create_dir(root, recursive=True)
        warc, lines, made = io.BytesIO(), [], []

        def flush() -> None:
            name = f"part-{task.partitionId():06d}-{len(made):04d}.zip"
            partial = f"{root}/{name}.{task.taskAttemptId()}"
            with store_fs.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                package.writestr(DATA, warc.getvalue())
                package.writestr(INDEX, "".join(lines))
                package.writestr(MANIFEST, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
            store_fs.move(partial, f"{root}/{name}")
            made.append(name)
            warc.seek(0)
            warc.truncate()
            lines.clear()

        for part in parts:
            for page, url, html, sha1, refers in zip(part.page_id, part.url, part.html, part.sha1, part.refers_to, strict=True):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                packed = record_bytes(page, url if isinstance(url, str) else None, payload, sha1, refers if isinstance(refers, str) else None)
                lines.append(f"{page} {json.dumps({'offset': warc.tell(), 'length': len(packed), 'filename': DATA})}\n")
                warc.write(packed)
                if warc.tell() >= package_bytes:
                    flush()
        if lines:
            flush()
        yield pd.DataFrame({"path": [f"{folder}/{name}" for name in made]}, dtype=object)

    return records.mapInPandas(write, "path string")


def locate(paths: DataFrame, per_span: int = 400) -> DataFrame:
    """(path, lengths, start): runs of records that follow each other in a package's stored WARC member."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part.path:
                source, name = open_folder(path)
                with source.open_input_file(name) as file:
                    members = {m.name: m for m in central_directory(file, file.size())}
                    start, index = data_position(file, members[DATA]), members[INDEX]
                    lines = _read_at(file, data_position(file, index), index.size).decode().splitlines()
                spans = [json.loads(x.partition(" ")[2]) for x in lines]
                cut = [spans[k : k + per_span] for k in range(0, len(spans), per_span)]
                yield pd.DataFrame({"path": [path] * len(cut), "start": [start + c[0]["offset"] for c in cut], "lengths": [[s["length"] for s in c] for c in cut]})

    return paths.mapInPandas(read, "path string, start long, lengths array<long>")


def read_records(spans: DataFrame) -> DataFrame:
    """Every record of ``spans``: page_id, payload_bytes, payload_digest, record_type, refers_to (ids as text), url.

    Payloads of responses are hashed anew and must have the digest and length their headers state.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, lengths in zip(part.path, part.start, part.lengths, strict=True):
                source, name = open_folder(path)
                rows = []
                with source.open_input_file(name) as file:
                    for length in lengths:
                        record = parse_record(_read_at(file, start, length))
                        start += length
                        headers = record["headers"]
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(record["http"]["content-length"])
                        if headers["warc-type"] == "response" and (hashlib.sha1(record["payload"]).hexdigest(), len(record["payload"])) != (digest, size):
                            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                        ids = [headers.get(k, "")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((ids[0], size, digest, headers["warc-type"], ids[1] or None, headers["warc-target-uri"]))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return spans.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) with sha1 and refers_to: the largest page_id of an equal payload, else null.

    Payloads under ``least`` bytes and the rows with the largest id themselves have null. Digests of more than a
    thousandth of all rows, of which there are at most a thousand, are sent to all tasks; the others are joined by
    digest, so no key of that join has more than a thousandth of the rows.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"))
    groups = store(base.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1"), "payloads")
    heavy_rows = max(1, pages.count() // HEAVY_PARTS)
    heavy = groups.where(F.col("n") > heavy_rows).select("sha1", F.col("target").alias("heavy"), F.lit(True).alias("is_heavy"))
    light = groups.where(F.col("n") <= heavy_rows).select(F.col("sha1").alias("key"), F.col("target").alias("light"))
    joined = base.join(F.broadcast(heavy), "sha1", "left")
    key = F.when(F.col("is_heavy").isNull() & (F.col("bytes") >= least), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "sha1").cast("string")))
    joined = joined.withColumn("key", key).join(light, "key", "left")
    target = F.coalesce("heavy", "light")
    return joined.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "url", "html", "sha1", F.when((target != F.coalesce(F.col("page_id"), target - 1)) & (F.col("bytes") >= least), target.cast("string")).alias("refers_to"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of ``pages`` as a WARC record in packages, then read the packages back.

    Nulls: html counts as empty, url as empty; a row without page_id is written and returned with a null id. Repeated
    rows and ids each have their record. An empty table gives none. Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    paths = store(write_packages(deduplicated(pages), folder), "packages")
    spans = store(locate(paths), "spans")
    found = read_records(spans.repartition(max(1, pages.sparkSession.sparkContext.defaultParallelism * 2)))
    as_id = lambda c: F.when(F.length(c) > 0, F.col(c).cast("long")).alias(c)
    return found.select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"), "url")
