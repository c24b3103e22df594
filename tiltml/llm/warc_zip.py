"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package holds two stored members: ``archive/data.warc.gz``, where each record is a gzip member
of its own, and ``indexes/index.cdxj``, one line a record with its place. The reader parses the
central directory (with ZIP64 fields) from the end of the file, finds the stored members, reads
the index and fetches runs of records by range reads.

Pages with equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the smallest page_id's
record is the response, the others are revisits that name it and carry no payload.

Defined cases: a null html is an empty payload; rows without an id revisit a row with one, and are
responses if there is none; rows that repeat the smallest id of their payload are all responses. A
null url is written as empty, control characters in it percent-encoded. An empty table gives no
rows. Payloads of any length are stored whole; one record at a time is held in full.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.llm.common import filesystem, load, materialize, pieces, shared_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 100
_RUN_RECORDS, _RUN_BYTES = 512, 8 << 20
READERS = 4  # tasks that read, for each package


# --- records --------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member holding a response or, if it refers to a page, a revisit record; ``date`` is its time in UTC."""
    payload = html.encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="".join(chr(c) for c in range(33, 127))), "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to),
                   "WARC-Payload-Length": str(len(payload))}
        payload = b""
    block = head + payload
    fields["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload after the HTTP head) of one gzip member."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]


# --- ZIP directory --------------------------------------------------------------------------

class ZipDirectory:
    """Members of a ZIP file by name, from its central directory; reads only what it needs.

    ``read(start, size)`` returns bytes of the file."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557 - 76)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # a comment may look like an end
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
            place = struct.unpack_from("<Q", tail, at - 12)[0]
            end = read(place, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 directory")
            entries, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # method, stored size, place of the local header
        data, at = read(start, length), 0
        for _ in range(entries):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            full, packed, offset = _zip64(data[at + 46 + n_name:at + 46 + n_name + n_extra], full, packed, offset)
            self.members[name] = (method, packed, offset)
            at += 46 + n_name + n_extra + n_note

    def stored(self, name: str) -> tuple[int, int]:
        """(start, size) in the file of a stored member's bytes."""
        method, size, place = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored but compressed")
        head = self.read(place, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return place + 30 + n_name + n_extra, size


def _zip64(extra: bytes, *values: int) -> list[int]:
    """full size, stored size and offset, where 32 bits don't hold them from the ZIP64 extra field."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            place = at + 4
            for i, v in enumerate(out):
                if v == 0xFFFFFFFF:
                    out[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + size
    return out


# --- packages -------------------------------------------------------------------------------

def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = first.where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """One package a partition below ``folder``, named after the task's attempt; the manifest: path, n_records. All records bear
    the time of the call, so a repeated task writes the same."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        task, (fs, root) = TaskContext.get(), filesystem(folder)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.zip"
        lines: list[str] = []
        out = package = member = None
        place = 0
        for batch in pieces(batches, "html"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
                package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(*row, date)
                member.write(data)
                lines.append(json.dumps({"page_id": row[0], "offset": place, "length": len(data)}))
                place += len(data)
        if out is not None:
            member.close()
            package.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
            package.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64())], ["path", "n_records"])

    return materialize(rows.mapInArrow(write, "path string, n_records long"), "packages")


def read_packages(manifest: DataFrame) -> DataFrame:
    """Per record, from the packages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def runs(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = filesystem(path)
                with fs.open_input_file(place) as f:
                    directory = ZipDirectory(lambda at, n, f=f: f.read_at(n, at), f.size())
                    start, _ = directory.stored(DATA)
                    at, size = directory.stored(INDEX)
                    held: list[tuple[int, int]] = []
                    for line in f.read_at(size, at).decode().splitlines():
                        x = json.loads(line)
                        held.append((start + x["offset"], x["length"]))
                        if len(held) == _RUN_RECORDS or held[-1][0] + held[-1][1] - held[0][0] >= _RUN_BYTES:
                            yield _run(path, held)
                            held = []
                    if held:
                        yield _run(path, held)

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as f:
                    data = f.read_at(offsets[-1] + lengths[-1] - offsets[0], offsets[0])
                rows = [_digest_row(*parse_record(data[o - offsets[0]:o - offsets[0] + n])) for o, n in zip(offsets, lengths, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    files = manifest.select("path")
    n = max(1, files.count())
    found = files.repartition(n).mapInArrow(runs, "path string, offsets array<long>, lengths array<long>")
    # places are small, what they stand for isn't: a number of partitions that isn't merged by size
    return found.repartition(READERS * n, "path", F.col("offsets")[0]).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _run(path: str, held: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[o for o, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, n in held]], pa.list_(pa.int64()))],
                                      ["path", "offsets", "lengths"])


def _page(name: str | None) -> int | None:
    number = (name or "")[len("<urn:page:"):-1]
    return int(number) if number else None


def _digest_row(fields: dict[str, str], payload: bytes) -> dict:
    row = {"page_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to"))}
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(fields["warc-payload-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(with_revisits(load(spark, sf_dir, "pages")), shared_path(spark, "warc")))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
