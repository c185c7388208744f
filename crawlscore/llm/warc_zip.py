"""Web archives in ZIP packages: WARC records written, located by the ZIP directories, range-read.

A task writes packages of three stored members: the gzip-compressed records one after another, an
index with offset and length of each in lines of one width, and a short description. A reader parses the
end record (with its ZIP64 forms) and the central directory, finds the members' places, and reads the
asked lines of the index and their records by range. A package is closed when its records reach
PACKAGE_BYTES, so that a task holds a bounded index. Nothing is extracted; only stored members can be read this way.

Of records with equal payloads that with the smallest id is the response, the others revisit it.

Defined results: a null payload is empty. A record without an id comes after all others, so it
revisits a copy that has one; where no copy has an id all are responses. Rows that share the smallest
id and the payload are all responses. Addresses are written percent-encoded. An empty table gives no
package and no rows. Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common, storage

RECORDS, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that one task reads, and bytes that it asks for at a time.
READ_RECORDS, READ_BYTES = 4_000, 4 << 20
#: Compressed bytes of records at which a package is closed, and bytes of a line of its index.
PACKAGE_BYTES, INDEX_WIDTH = 64 << 20, 160
LEVEL = 3
_NAME = "urn:x-page:"


# --- records -------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (without payload) where `refers_to` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{_NAME}{'' if page is None else page}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    body = rest[:int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return warc, fields, payload


def _page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_NAME)
    return int(number) if number else None


# --- packages ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """Where a stored member's bytes lie in the package."""

    start: int
    size: int


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """The values, with those that are all ones taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for k, value in enumerate(values):
                if value == 0xFFFFFFFF:
                    values[k] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
            break
        at += 4 + size
    return values


def directory(system: fs.FileSystem, path: str) -> dict[str, Member]:
    """The stored members of a package by name."""
    size = system.get_file_info(path).size
    tail_start = max(0, size - 65_557 - 76)  # the longest comment, and the ZIP64 end record with its locator
    tail = storage.read_range(system, path, tail_start, size - tail_start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError(f"no end of central directory in {path}")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if tail[end - 20:end - 16] != b"PK\x06\x07":
            raise ValueError(f"no ZIP64 locator in {path}")
        place = struct.unpack_from("<Q", tail, end - 12)[0]
        far = storage.read_range(system, path, place, 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError(f"no ZIP64 end record in {path}")
        count, length, start = struct.unpack_from("<QQQ", far, 32)
    raw = storage.read_range(system, path, start, length)
    found, at = {}, 0
    for _ in range(count):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError(f"broken central directory in {path}")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        local, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
        whole, packed, local = _zip64(extra, [whole, packed, local])
        if method == 0:
            head = storage.read_range(system, path, local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"broken local header of {name} in {path}")
            skip = struct.unpack_from("<HH", head, 26)
            found[name] = Member(local + 30 + sum(skip), whole)
        at += 46 + n_name + n_extra + n_comment
    return found


def index(system: fs.FileSystem, path: str, members: dict[str, Member], first: int = 0,
          last: int | None = None) -> list[tuple[int, int]]:
    """Offset and length of the records first..last-1 within the records' member."""
    member = members[INDEX]
    begin = min(first * INDEX_WIDTH, member.size)
    end = member.size if last is None else min(last * INDEX_WIDTH, member.size)
    lines = storage.read_range(system, path, member.start + begin, end - begin).decode().splitlines()
    entries = [json.loads(line.split(" ", 2)[2]) for line in lines]
    return [(e["offset"], e["length"]) for e in entries]


def records(system: fs.FileSystem, path: str, first: int = 0, last: int | None = None) -> Iterator[bytes]:
    """The records first..last-1 of a package; neighbours are fetched together."""
    members = directory(system, path)
    places = index(system, path, members, first, last)
    base, k = members[RECORDS].start, 0
    while k < len(places):
        begin, stop, j = places[k][0], sum(places[k]), k + 1
        while j < len(places) and places[j][0] == stop and stop + places[j][1] - begin <= READ_BYTES:
            stop += places[j][1]
            j += 1
        raw = storage.read_range(system, path, base + begin, stop - begin)
        for offset, length in places[k:j]:
            yield zlib.decompress(raw[offset - begin:offset - begin + length], wbits=31)
        k = j


# --- jobs ----------------------------------------------------------------------------------------


def _with_first_copy(pages: DataFrame, page: str, url: str, payload: str, least: int) -> DataFrame:
    """(page, url, payload, refers_to); only digests are shuffled to find copies.

    Digests that occur once leave no row behind, and the join of the rest is Spark's to plan: a
    broadcast below its threshold, else a sort-merge join in which a hot digest is split.
    """
    own = pages.select(F.col(f"`{page}`").cast("bigint").alias("page"), F.col(f"`{url}`").alias("url"),
                       F.coalesce(F.encode(F.col(f"`{payload}`"), "utf-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    copies = (own.where(F.length("payload") >= least).groupBy("digest")
              .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
    joined = own.join(copies.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") > F.col("first"))), F.col("first"))
    return joined.select("page", "url", "payload", refers.alias("refers_to"))


class _Package:
    """A package being written."""

    def __init__(self, system: fs.FileSystem, base: str, date: str):
        _, self.name = storage.attempt_name("pages", ".wacz")
        self.date, self.place, self.lines = date, 0, []
        system.create_dir(base, recursive=True)
        self.target = system.open_output_stream(f"{base}/{self.name}")
        self.package = zipfile.ZipFile(self.target, "w", zipfile.ZIP_STORED)
        self.member = self.package.open(RECORDS, "w", force_zip64=True)

    def add(self, page: int | None, raw: bytes) -> None:
        entry = json.dumps({"page": page, "offset": self.place, "length": len(raw)})
        line = f"- {self.date} {entry}".ljust(INDEX_WIDTH - 1) + "\n"
        if len(line) != INDEX_WIDTH:
            raise ValueError(f"date too long for the index: {self.date}")
        self.member.write(raw)
        self.lines.append(line)
        self.place += len(raw)

    def close(self) -> pa.RecordBatch:
        """The package's row of the manifest."""
        n = len(self.lines)
        self.member.close()
        self.package.writestr(INDEX, "".join(self.lines))
        self.package.writestr(ABOUT, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": n}))
        self.package.close()
        self.target.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([n], pa.int64())], names=["file", "n_records"])


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", payload: str = "html",
          least: int = 0, date: str = "2024-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages and returns their manifest (file, n_records) as a written table.

    `least` is the number of bytes from which equal payloads are written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage.opened(folder)
        package = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("page", "url", "payload", "refers_to")}
                if package is None:
                    package = _Package(system, base, date)
                pack = zlib.compressobj(LEVEL, wbits=31)
                raw = record(row["page"], row["url"], row["payload"], row["refers_to"], date)
                package.add(row["page"], pack.compress(raw) + pack.flush())
                if package.place >= package_bytes:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    rows = _with_first_copy(pages, page, url, payload, least)
    return common.materialise(rows.mapInArrow(run, "file string, n_records bigint"), "package-manifest")


_READ = "page bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the packages; payloads (null for revisits) on request."""
    spans = manifest.select("file", F.explode(F.sequence(F.lit(0), F.col("n_records") - 1, F.lit(READ_RECORDS))).alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage.opened(folder)
        schema = pa.schema([("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for span in batch.to_pylist():
                rows, held = [], 0
                for raw in records(system, f"{base}/{span['file']}", span["first"], span["first"] + READ_RECORDS):
                    warc, http, payload = parsed(raw)
                    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"damaged record {warc['warc-record-id']} in {span['file']}")
                    rows.append((_page_of(warc["warc-record-id"]), int(http["content-length"]), digest, kind,
                                 _page_of(warc.get("warc-refers-to")), payload if payloads and kind == "response" else None))
                    held += len(payload) if payloads else 64
                    if held >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spans.repartition(parts, "file", "first").mapInArrow(run, _READ)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records in packages and read back."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = common.new_folder(spark, "packages")
    found = read(spark, folder, write(pages, folder), payloads=False)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits make four of base 32.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - k % 4 * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p
"""
