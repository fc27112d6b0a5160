"""WARC records in ZIP archives: written as stored members, read back by ranges without extraction.

Layout of an archive: ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj``
(offset and length of each record), both stored.  Reading parses the end record, the ZIP64 locator and record,
the central directory and the local headers, then reads only the index and the records' ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.llm.shared import FILE, ROW, SideReader, addressed, cut, hot_keys, left_join, new_folder, open_store, put_side

#: Compressed bytes after which a task begins another archive.
ROLL = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ZIP ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> int:
    """Write stored members; ``zip64`` (or sizes that need it) adds the 64-bit fields and end records."""
    at, directory = 0, []
    for name, data in members:
        raw, crc, big = name.encode(), zlib.crc32(data), zip64 or len(data) >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = 0xFFFFFFFF if big else len(data)
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(more), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + more)
        out.write(head)
        out.write(data)
        at += len(head) + len(data)
    body = b"".join(directory)
    out.write(body)
    total = at + len(body)
    if zip64 or at >= 0xFFFFFFFF or len(members) >= 0xFFFF:
        tail = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(body), at) + struct.pack("<IIQI", 0x07064B50, 0, total, 1)
        tail += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        tail = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(members), len(members), len(body), at, 0)
    out.write(tail)
    return total + len(tail)


class ZipReader:
    """Random access to a ZIP file's stored members; ``read_at(offset, length)`` is all that it needs of the store."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        tail_at = max(0, size - 65_557)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature also occurs in comments
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            mark, _, at, _ = struct.unpack("<IIQI", read_at(tail_at + end - 20, 20))
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            record = read_at(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._directory(read_at(start, length), count)}

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            (mark, _, _, flags, method, _, _, crc, packed, size, n, m, c, _, _, _, header) = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
            if mark != 0x02014B50:
                raise ValueError("bad central directory")
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n : at + 46 + n + m], 0
            while k + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, k)
                if tag == 1:
                    p = k + 4
                    if size == 0xFFFFFFFF:
                        size, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                    if packed == 0xFFFFFFFF:
                        packed, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, p)[0]
                k += 4 + length
            yield Member(name, method, crc, packed, size, header)
            at += 46 + n + m + c

    def data_start(self, member: Member) -> int:
        """Where a member's bytes begin: its local header has its own name and extra lengths."""
        head = self.read_at(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        n, m = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + m

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        return self.read_at(self.data_start(member) + offset, member.size - offset if length is None else length)


# -- WARC --------------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP head alone and names the record that holds the payload."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Header fields (names lower-case), the block after the HTTP head, and the HTTP head's fields."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return fields, body, inner


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# -- Spark -------------------------------------------------------------------------------------------------------


def payload_key(pages: DataFrame):
    return F.sha2(F.coalesce(pages["html"], F.lit("")).cast("binary"), 256)


def revisits(pages: DataFrame, total: int) -> DataFrame:
    """``FILE, ROW, value`` of the addressed pages that revisit another: the largest page_id holds a payload that
    several share.  Digests alone are grouped and joined, those of hot payloads in several tasks."""
    keyed = pages.select(payload_key(pages).alias("sha"), F.col("page_id").cast("long").alias("page_id"), FILE, ROW)
    shared = keyed.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("value")).where("n > 1")
    shared = cut(shared, "responders")
    joined = left_join(keyed, shared, "sha", hot_keys(shared, "sha", "n", total), F.col(ROW))
    return joined.where(F.col("value").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("value"))).select(FILE, ROW, "value")


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write a record for each row of ``pages (page_id, url, html)``; returns the manifest ``path, records, bytes``.

    A task names its files by a random id and only files in the manifest count, so lost or repeated tasks leave
    nothing that is read.  The payloads' holders are found on digests and put in side files, which the one pass over
    the pages reads: pages are never shuffled.  A null URL is written as ``about:blank``.  A record is made whole in
    memory, an archive of ``roll`` compressed bytes or one record more.
    """
    pages = addressed(pages)
    total = pages.count()
    side = put_side(revisits(pages, total), total, "revisits")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary"), side.part(), FILE, ROW)
    kind = StructType.fromDDL("path string, records long, bytes long")
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        held, index, reader = bytearray(), [], SideReader(side, values=True)

        def flush() -> pa.RecordBatch:
            nonlocal held, index
            name = f"pages-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(posixpath.join(base, name)) as out:
                size = write_zip(out, [(DATA, bytes(held)), (INDEX, "\n".join(index).encode())])
            got = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [size]}, schema=target)
            held, index = bytearray(), []
            return got

        for batch in batches:
            refers = reader.find(*(batch.column(i).to_numpy() for i in (3, 4, 5)))[1]
            for page_id, url, body, refers_to in zip(*(batch.column(i).to_pylist() for i in range(3)), refers, strict=True):
                packed = gzip_member(record(page_id, url, body, refers_to))
                index.append(json.dumps({"page": page_id, "offset": len(held), "length": len(packed)}))
                held += packed
                if len(held) >= roll:
                    yield flush()
        if index:
            yield flush()

    return cut(rows.mapInArrow(run, kind), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload`` of every indexed record.

    A revisit's payload is null; its ``payload_bytes`` is what its HTTP head states; a null URL comes back as
    ``about:blank``.  A response whose payload does
    not match its digest raises ``ValueError``.
    """
    kind = StructType.fromDDL("page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary")
    target = to_arrow_schema(kind)

    def number(urn: str) -> int | None:
        inner = urn.strip("<>").rpartition(":")[2]
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = open_store(path)
                with store.open_input_file(inner) as f:
                    reader = ZipReader(lambda offset, length, f=f: f.read_at(length, offset), f.size())
                    start = reader.data_start(reader.members[DATA])
                    entries = [json.loads(x) for x in reader.read(INDEX).decode().splitlines()]
                    rows: list[tuple] = []
                    held = 0
                    for e in entries:
                        fields, body, http = parse_record(zlib.decompress(f.read_at(e["length"], start + e["offset"]), 31))
                        stated, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                        if not revisit and digest_of(body) != stated:
                            raise ValueError(f"{path}: payload of page {e['page']} does not match its digest")
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], stated, number(fields["warc-refers-to"]) if revisit else None, int(http["content-length"]) if revisit else len(body), None if revisit else body))
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    archives = manifest.select("path")
    return archives.repartition(max(1, min(archives.count(), 100_000))).mapInArrow(run, kind)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and describe each record.

    Null html counts as empty.  Of equal payloads the largest page_id is the response (rows that repeat this id too)
    and the others revisit it; a null id ranks lowest.  Other columns are not read.  An empty table gives no rows.
    """
    manifest = write_archives(pages, new_folder(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
