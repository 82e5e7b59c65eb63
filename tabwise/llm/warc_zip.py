"""WARC records in ZIP packages: write, and range-read without extraction.

A package is a ZIP file with stored (uncompressed) members: the WARC file, whose
records are gzip members of their own, and an index with a line for each record
(offset, length). ``read_packages`` never extracts a package. It reads the end
of the file, follows the end-of-central-directory record (and the ZIP64 record
and fields if a size, an offset or the number of members needs them), walks the
central directory to the index and archive members, takes the place of each
member's data from its local header, and then reads index chunks and record
ranges by offset. Records are dealt out in chunks of index lines, so a large
package is read by many tasks.

Writing. Records of equal payload (SHA-1 and size) of at least ``MIN_REVISIT``
bytes are one response, the row with the largest id, and revisits that refer to
it. Equal payloads are found by a grouped maximum (partial aggregates: a payload
that fills a third of the rows is one row of each task); the table of payloads
that occur more than once is joined back. A task writes its rows to packages of
at most ``PACKAGE_BYTES``, named by its attempt; the list of packages, a table in
the shared folder, names those of the attempts that succeeded.

Defined results: null html is an empty payload; records below the size bound and
rows whose group has no non-null id are responses. All rows with the group's
largest id are responses (repeated rows). A null id is written as none and read
as null. Empty table: no package, no record. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import filesystem, materialize, shared_path, steps, table, text_bytes

MIN_REVISIT = 1000
#: WARC bytes after which a task starts another package; index lines of a chunk; record bytes read at once.
PACKAGE_BYTES, CHUNK_LINES, READ_BYTES = 256 << 20, 512, 8 << 20
#: Chunks of an index that a task reads the records of at most (fewer while there are idle cores).
TASK_CHUNKS = 16
DATE = "2000-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"


# --- records ---------------------------------------------------------------------------------------------------------

def _block(first: str, headers: dict[str, str | int | None]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in headers.items() if v is not None), "", ""]).encode()


def _header_value(text: str | None) -> str | None:
    """A header holds one line: control characters are percent-encoded."""
    return None if text is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it that refers to a response's id."""
    size, kind = len(payload), "response" if refers_to is None else "revisit"
    http = _block("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": size})
    body = http + payload if refers_to is None else http
    return _block("WARC/1.1", {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{kind}:{digest}')}>", "WARC-Date": date,
        "WARC-Target-URI": _header_value(url), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id, "X-Payload-Length": size,
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Refers-To-Page-Id": refers_to, "Content-Type": "application/http; msgtype=response", "Content-Length": len(body),
    }) + body + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Headers of a block and where its body starts."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def parse_record(data: bytes) -> dict:
    """The fields of an uncompressed record; the payload of a response is checked against its digest."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    head, at = _headers(data)
    body = data[at:at + int(head["content-length"])]
    kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda k: int(head[k]) if k in head else None
    payload = None
    if kind == "response":
        payload = body[_headers(body)[1]:]
        found = hashlib.sha1(payload).hexdigest()
        if digest and found != digest:
            raise ValueError(f"payload of page {head.get('x-page-id')} does not have the digest of its record")
        digest = found
    return {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "payload": payload,
            "payload_bytes": number("x-payload-length") if payload is None else len(payload), "refers_to": number("x-refers-to-page-id")}


# --- packages --------------------------------------------------------------------------------------------------------

class PackageWriter:
    """Streams gzip members into a stored WARC member of a new ZIP file; its index and description follow at the end."""

    def __init__(self, stream, level: int = 1):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.lines, self.size, self.level = [], 0, level

    def add(self, data: bytes, **index) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.lines.append(json.dumps({"offset": self.size, "length": len(packed), **index}))
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(f"{x}\n" for x in self.lines))
        about = {"profile": "data-package", "resources": [{"path": WARC_MEMBER, "bytes": self.size}, {"path": INDEX_MEMBER, "records": len(self.lines)}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self.zip.close()


def central_directory(read_at, size: int) -> dict[str, dict[str, int]]:
    """Members of a ZIP file (method, size, header offset) by name. read_at(offset, n) reads a range; size: of the file."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0:  # the comment could hold the signature: the record must end with the file
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    members, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    place = tail_at + locator
    if place >= 0 and (tail[locator:locator + 4] if locator >= 0 else read_at(place, 4)) == b"PK\x06\x07":
        wide_at = struct.unpack("<4xIQI", read_at(place, 20))[1]
        wide = read_at(wide_at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 locator without its record")
        members, length, start = struct.unpack_from("<QQQ", wide, 32)
    elif 0xFFFF in (members,) or 0xFFFFFFFF in (length, start):
        raise ValueError("ZIP64 fields without a locator")
    data, at, found = read_at(start, length), 0, {}
    for _ in range(members):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        found[name] = {"method": method, "encrypted": flags & 1, "packed": packed, "size": plain, "header": header}
        at += 46 + n_name + n_extra + n_comment
    return found


def member_start(read_at, member: dict[str, int]) -> int:
    """Where the data of a stored member starts: after its local header, whose extra field has a length of its own."""
    if member["method"] != 0 or member["encrypted"]:
        raise ValueError("only stored members can be read by range")
    head = read_at(member["header"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the central directory says")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def _reader(stream):
    def read_at(offset: int, n: int) -> bytes:
        stream.seek(offset)
        return stream.read(n)
    return read_at


# --- Spark -----------------------------------------------------------------------------------------------------------

def _with_roles(pages: DataFrame, page_id: str, url: str, html: str, min_revisit: int) -> DataFrame:
    """__id, __url, __payload, __digest and __refers (the response's id of a revisit) of every row."""
    rows = pages.select(F.col(page_id).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), text_bytes(F.col(html)).alias("__payload"))
    rows = rows.withColumn("__digest", F.sha1("__payload")).withColumn("__size", F.octet_length("__payload"))
    equal = (rows.filter(F.col("__size") >= min_revisit).groupBy(F.col("__digest").alias("d"), F.col("__size").alias("s"))
             .agg(F.max("__id").alias("__first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    equal = materialize(equal, "equal-payloads")
    joined = rows.join(equal, (rows["__digest"] == equal["d"]) & (rows["__size"] == equal["s"]), "left")
    refers = F.when(F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first"))
    return joined.select("__id", "__url", "__payload", "__digest", refers.alias("__refers"))


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT,
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the pages as packages below ``folder``; returns (package, records) of every package."""
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(folder)
        writer = stream = name = None
        done = []

        def finish() -> None:
            nonlocal writer
            if writer:
                writer.close()
                stream.close()
                done.append((name, len(writer.lines)))
                writer = None

        for batch in steps(batches, "__payload"):
            columns = (batch.column(c).to_pylist() for c in ("__id", "__url", "__payload", "__digest", "__refers"))
            for page, address, payload, digest, refers in zip(*columns):
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    stream = fs.open_output_stream(f"{where}/{name}")
                    writer = PackageWriter(stream)
                writer.add(record(page, address, payload, digest, refers), page=page)
                if writer.size >= package_bytes:
                    finish()
        finish()
        if done:
            yield pa.RecordBatch.from_pydict({"package": [n for n, _ in done], "records": [r for _, r in done]},
                                             schema=pa.schema([("package", pa.string()), ("records", pa.int64())]))

    rows = _with_roles(pages, page_id, url, html, min_revisit)
    rows.mapInArrow(run, "package string, records long").write.parquet(f"{folder}/_packages")
    return pages.sparkSession.read.parquet(f"{folder}/_packages")


_CHUNK = "package string, first long, spans array<struct<offset:long,length:long>>"
_RECORD = "page_id long, url string, record_type string, payload_digest string, payload binary, payload_bytes long, refers_to long"
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                           ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])


def read_packages(packages: DataFrame, folder: str, payloads: bool = True, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Every record of the packages named in ``packages.package`` below ``folder``; payload is null for revisits, and for all without ``payloads``."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(folder)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                with fs.open_input_file(f"{where}/{name}") as stream:
                    read_at = _reader(stream)
                    members = central_directory(read_at, stream.size())
                    base = member_start(read_at, members[WARC_MEMBER])
                    index = members[INDEX_MEMBER]
                    lines = io.BufferedReader(_Range(read_at, member_start(read_at, index), index["size"]))
                    first = 0
                    while part := [json.loads(line) for line in islice(lines, chunk_lines)]:
                        spans = [{"offset": base + x["offset"], "length": x["length"]} for x in part]
                        yield pa.RecordBatch.from_pydict({"package": [name], "first": [first], "spans": [spans]}, schema=pa.schema([
                            ("package", pa.string()), ("first", pa.int64()), ("spans", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]))
                        first += len(part)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(folder)
        for batch in batches:
            for name, spans in zip(batch.column("package").to_pylist(), batch.column("spans").to_pylist()):
                with fs.open_input_file(f"{where}/{name}") as stream:
                    read_at = _reader(stream)
                    for group in _runs(spans):
                        start = group[0]["offset"]
                        data = read_at(start, group[-1]["offset"] + group[-1]["length"] - start)
                        rows = [parse_record(zlib.decompress(data[x["offset"] - start:x["offset"] - start + x["length"]], 31)) for x in group]
                        if not payloads:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    found = materialize(packages.select("package").repartition("package").mapInArrow(chunks, _CHUNK), "warc-chunks")
    # A chunk's row is small, but stands for all the records that it lists: a stated number of tasks, which no small size makes fewer.
    n = found.count()
    tasks = max(-(-n // TASK_CHUNKS), min(n, 2 * packages.sparkSession.sparkContext.defaultParallelism), 1)
    return found.repartition(tasks).mapInArrow(records, _RECORD)


class _Range(io.RawIOBase):
    """A range of a file as a stream."""

    def __init__(self, read_at, start: int, size: int):
        self.read_at, self.at, self.end = read_at, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.end - self.at)
        buffer[:n] = self.read_at(self.at, n)
        self.at += n
        return n


def _runs(spans: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring records that are read at once: READ_BYTES at most, unless one alone is longer."""
    run: list[dict] = []
    for x in spans:
        if run and (x["offset"] != run[-1]["offset"] + run[-1]["length"] or x["offset"] + x["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page, read the packages back and describe the records."""
    folder = shared_path(spark, "warc")
    packages = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(packages, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest,
             CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, octet_length(b)) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""
