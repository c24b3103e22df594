import hashlib
import io
import re
import struct
import zipfile

import pytest

from tiltml.llm import warc_zip as Z
from tiltml.llm.queries import QUERIES


def directory(data):
    return Z.ZipDirectory(lambda at, n: data[at:at + n], len(data))


def test_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "html").collect()]
    first = {}
    for i, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in QUERIES["op7_warc_zip"](spark, tables).collect())


def test_record_round_trip():
    for html, refers in (("", None), ("é\r\n\r\nx", None), ("payload", 7)):
        fields, payload = Z.parse_record(Z.record(5, "http://a\r\nWARC-Type: x", html, "d", refers))
        assert fields["warc-type"] == ("response" if refers is None else "revisit")
        assert payload.decode() == ("" if refers else html)
        assert fields["warc-payload-digest"] == "sha256:d"
        # what the format asks of every record
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])


def test_members_of_a_plain_package():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"stored bytes")
        z.writestr("ü/b.txt", b"packed" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    d = directory(out.getvalue())
    start, size = d.stored("a.txt")
    assert out.getvalue()[start:start + size] == b"stored bytes" and set(d.members) == {"a.txt", "ü/b.txt"}
    with pytest.raises(ValueError):
        d.stored("ü/b.txt")


def test_zip64_directory():
    """A package whose sizes, offsets and directory stand in ZIP64 fields only."""
    body = b"0123456789"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"m" + struct.pack("<HHQQ", 1, 16, 10, 10) + body
    extra = struct.pack("<HHI", 9, 4, 0) + struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    data = local + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    start, size = directory(data).stored("m")
    assert data[start:start + size] == body


def test_broken_packages():
    for data in (b"", b"no zip", b"PK\x05\x06" + b"\0" * 10):
        with pytest.raises(ValueError):
            directory(data)


def test_packages_open_with_the_standard_library(spark, tables, tmp_path):
    manifest = Z.write_packages(Z.with_revisits(spark.read.parquet(f"{tables}/pages.parquet")), str(tmp_path))
    paths = [r.path for r in manifest.collect()]
    names = {n for p in paths for n in zipfile.ZipFile(p.removeprefix("file:")).namelist()}
    assert names == {Z.DATA, Z.INDEX}


def test_empty_table(spark, empty_tables):
    assert QUERIES["op7_warc_zip"](spark, empty_tables).count() == 0
