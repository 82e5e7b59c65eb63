import gzip
import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tabwise.llm import warc_zip
from tabwise.llm.common import filesystem, shared_path


def _read_at(data):
    return lambda at, n: data[at:at + n]


def _package(n=5, **options):
    out = io.BytesIO()
    writer = warc_zip.PackageWriter(out)
    for i in range(n):
        body = f"page {i}".encode()
        writer.add(warc_zip.record(i, "http://x/\r\nInjected: 1", body, hashlib.sha1(body).hexdigest(), None), page=i)
    writer.close()
    return out.getvalue()


def test_directory_agrees_with_zipfile():
    data = _package()
    found = warc_zip.central_directory(_read_at(data), len(data))
    archive = zipfile.ZipFile(io.BytesIO(data))
    assert set(found) == set(archive.namelist()) and archive.testzip() is None
    for name, member in found.items():
        start = warc_zip.member_start(_read_at(data), member)
        assert data[start:start + member["size"]] == archive.read(name)
    everything = gzip.decompress(archive.read(warc_zip.WARC_MEMBER))
    assert everything.count(b"WARC/1.1\r\n") == 5 and b"\r\nInjected" not in everything


def test_comment_with_signature_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text " * 100)
        z.writestr("ä.txt", "")
        z.comment = b"x PK\x05\x06" + b"y" * 40
    data = out.getvalue()
    found = warc_zip.central_directory(_read_at(data), len(data))
    assert set(found) == {"a.txt", "ä.txt"} and found["a.txt"]["size"] == 500
    with pytest.raises(ValueError):
        warc_zip.member_start(_read_at(data), found["a.txt"])
    for bad in (b"", b"PK", b"x" * 100):
        with pytest.raises(ValueError):
            warc_zip.central_directory(_read_at(bad), len(bad))


def test_zip64_directory():
    """A package whose directory has only 64-bit values, padded as if the file were large."""
    name, content, gap = b"archive/data.warc.gz", b"stored bytes", 1 << 33
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(content), len(content))
    extra = struct.pack("<HH", 0x5455, 1) + b"\0" + struct.pack("<HHQQQ", 1, 24, len(content), len(content), gap)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    body = local + content
    start = gap + len(body)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = body + central + wide + locator + end

    def read_at(at, n):
        return b"\0" * max(0, min(n, gap - at)) + tail[max(0, at - gap):max(0, at - gap) + n - max(0, gap - at)] if at + n > gap else b"\0" * n

    found = warc_zip.central_directory(read_at, gap + len(tail))
    assert found == {"archive/data.warc.gz": {"method": 0, "encrypted": 0, "packed": len(content), "size": len(content), "header": gap}}
    at = warc_zip.member_start(read_at, found["archive/data.warc.gz"])
    assert read_at(at, len(content)) == content


def test_damaged_payload_is_noticed():
    data = warc_zip.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc_zip.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc_zip.parse_record(data.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"))


def _want(rows):
    groups = {}
    for page_id, _, html in rows:
        if page_id is not None:
            groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        first = max(groups.get(payload, [-1])) if len(payload) >= 1000 and sum((h or "").encode() == payload for *_, h in rows) > 1 else page_id
        first = page_id if first == -1 else first
        out.append((page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "READ_BYTES", 700)
    big = "é<p>same</p>\r\n\r\n" * 100
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<p>{i}</p>" * (i * 20)) for i in range(40)]
    rows += [(90, None, None), (91, "", ""), (None, "x\ny", big), (92, "z" * 5000, "q" * 999), (93, "z", "q" * 999), (3, "again", big), (39, "http://h/39", big), (None, "n", "m" * 2000), (None, "n", "m" * 2000)]
    df = spark.createDataFrame([(a, b, c, "d", 1) for a, b, c in rows], "page_id long, url string, html string, payload string, package int").repartition(3)
    folder = shared_path(spark, "t")
    packages = warc_zip.write_packages(df, folder, package_bytes=2000)
    assert packages.count() > 3
    got = warc_zip.read_packages(packages, folder, chunk_lines=4).collect()
    want = [(a, b.replace("\n", "%0A") if b else b, *rest) for a, b, *rest in _want(rows)]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    fs, where = filesystem(folder)
    with fs.open_input_file(f"{where}/{packages.first().package}") as f:
        assert zipfile.ZipFile(f).testzip() is None
    empty = shared_path(spark, "t")
    assert warc_zip.read_packages(warc_zip.write_packages(df.filter(F.lit(False)), empty), empty).count() == 0
