"""Page archives: WARC records in ZIP packages, written by tasks and read back by ranges.

A package holds archive/data.warc.gz (each record a gzip member of its own) and indexes/index.cdxj, both stored without
compression of the package, so that a record is found by the central directory and the index and read by its range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut, partitions, shared_folder

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins another package, and bytes that a reader asks for at once.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Fixed values of the WARC and ZIP formats: the profile of a revisit record, signatures and sizes of directory records.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_RECORD, END64_LOCATOR, END64_RECORD, DIRECTORY_ENTRY, LOCAL_HEADER = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, first: str | None, date: str) -> bytes:
    """One WARC record; first: the page that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def package(members: list[bytes], names: list[str | None]) -> bytes:
    """A ZIP package with 64-bit sizes of gzip members and of their index."""
    out, at, lines = io.BytesIO(), 0, []
    for name, member in zip(names, members, strict=True):
        lines.append(json.dumps({"page": name, "offset": at, "length": len(member)}))
        at += len(member)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((RECORDS, members), (INDEX, [("\n".join(lines)).encode("utf-8", "surrogatepass")])):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                for part in parts:
                    f.write(part)
    return out.getvalue()


class Package:
    """Reads a package by ranges; source has size() and read_at(nbytes, offset)."""

    def __init__(self, source) -> None:
        self.source = source
        self.members = self.directory()

    def directory(self) -> dict[str, tuple[int, int, int]]:
        """Name to (method, stored size, place of the local header), from the central directory, ZIP64 fields included."""
        size = self.source.size()
        tail_at = max(0, size - 66_000)
        tail = self.source.read_at(size - tail_at, tail_at)
        end = tail.rfind(END_RECORD)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
            locator = tail.rfind(END64_LOCATOR, 0, end)
            if locator < 0:
                raise ValueError("no ZIP64 locator")
            (place,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
            record64 = self.source.read_at(56, place)
            if record64[:4] != END64_RECORD:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack("<QQQ", record64[32:56])
        raw, at, out = self.source.read_at(length, start), 0, {}
        for _ in range(count):
            if raw[at : at + 4] != DIRECTORY_ENTRY:
                raise ValueError("broken central directory")
            method, stored, full = struct.unpack("<H", raw[at + 10 : at + 12])[0], *struct.unpack("<II", raw[at + 20 : at + 28])
            names, extras, comments = struct.unpack("<HHH", raw[at + 28 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + names].decode("utf-8", "replace")
            extra, e = raw[at + 46 + names : at + 46 + names + extras], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[e : e + 4])
                if kind == 1:
                    # Only the fields that overflow are there, in this order.
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + n
            out[name] = (method, stored, header)
            at += 46 + names + extras + comments
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, stored, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed in the package")
        local = self.source.read_at(30, header)
        if local[:4] != LOCAL_HEADER:
            raise ValueError("broken local header")
        names, extras = struct.unpack("<HH", local[26:30])
        return header + 30 + names + extras, stored

    def records(self) -> Iterator[bytes]:
        """The records in the order of the index; neighbouring ranges are read together."""
        begin, size = self.locate(INDEX)
        data, _ = self.locate(RECORDS)
        wanted = [(x["offset"], x["length"]) for x in map(json.loads, self.source.read_at(size, begin).decode("utf-8", "surrogatepass").splitlines())]
        i = 0
        while i < len(wanted):
            j, start = i + 1, wanted[i][0]
            while j < len(wanted) and wanted[j][0] == wanted[j - 1][0] + wanted[j - 1][1] and wanted[j][0] + wanted[j][1] - start <= RANGE_BYTES:
                j += 1
            held = self.source.read_at(wanted[j - 1][0] + wanted[j - 1][1] - start, data + start)
            for offset, length in wanted[i:j]:
                yield zlib.decompress(held[offset - start : offset - start + length], 31)
            i = j


def parsed(raw: bytes) -> dict:
    """Fields of a record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    name = lambda x: x[len("<urn:page:") : -1] or None
    revisit = fields["WARC-Type"] == "revisit"
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    out = {"page_id": name(fields["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": name(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}
    if not revisit and (len(payload) != size or digest_of(payload) != out["payload_digest"]):
        raise ValueError("a record's payload differs from its digest")
    return out


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a WARC record for each page into ZIP packages in a shared folder; returns the manifest (package, records, bytes).

    The project has no records of web pages, so this is general. The payload is the html in UTF-8 (null: empty). Of pages
    with equal payloads of at least least_bytes bytes those with the smallest page_id are response records, the others
    revisit it; smaller payloads are all response. A null page_id is never the smallest unless its payload has no other.
    Repeated rows are each written. Each package has a name of its own, and only those in the manifest count: what a lost
    or repeated task leaves is never read. Further columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary"))))
    first = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    marked = rows.join(first, "digest", "left").select(F.col("id").cast("string"), "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("first"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        members, names, size = [], [], 0

        def put() -> pd.DataFrame:
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            raw = package(members, names)
            with store.open_output_stream(name) as f:
                f.write(raw)
            return pd.DataFrame({"package": [name.rpartition("/")[2]], "records": [len(members)], "bytes": [len(raw)]})

        for frame in batches:
            for i, u, h, f in zip(frame["id"], frame["url"], frame["html"], frame["first"], strict=True):
                members.append(gzipped(record(i, u, h.encode("utf-8", "surrogatepass"), f, date)))
                names.append(i)
                size += len(members[-1])
                if size >= PACKAGE_BYTES:
                    yield put()
                    members, names, size = [], [], 0
        if members:
            yield put()

    return cut(marked.mapInPandas(write, "package string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the packages in a manifest: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    Sizes and digests are those of the full payload, for revisits too. A response whose payload doesn't match its digest
    is an error. page_id and refers_to are strings.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for frame in batches:
            for name in frame["package"]:
                with store.open_input_file(f"{root}/{name}") as source:
                    held, size = [], 0
                    for raw in Package(source).records():
                        held.append(parsed(raw))
                        size += len(raw)
                        if size >= RANGE_BYTES:
                            yield pd.DataFrame(held)
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held)

    return manifest.select("package").repartition(partitions(manifest.sparkSession), "package").mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def new_archive_folder(spark) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
