"""WARC records in ZIP packages, and a reader that takes them out by range.

A package has the stored (not deflated) members ``archive/data.warc.gz``, a gzip member per record, and
``indexes/index.jsonl``, a line per record with its place; sizes may need the ZIP64 directories. The reader parses the end
record, the ZIP64 locator and directory, the central directory and the local header of a member, and then reads
ranges of the package; nothing is extracted.

Among records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and
the others revisit it; smaller payloads are all responses. A null html is an empty payload. A row without page_id is
a response by itself. Repeated rows with the smallest page_id are all responses. Other columns but url are ignored; an
empty table gives no packages.

Packages go to the shared folder through its file system, under a name of the task's attempt; only names that a
finished task reports are read, so a lost executor leaves at most an unused file.
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
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
ROLL = 32 * 1024 * 1024


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload length that the HTTP header states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, stated


def package(data: bytes, index: bytes, zip64: bool = False) -> bytes:
    """A ZIP file with both members stored; ``zip64`` forces the large form of the local headers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, data), (INDEX, index)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                member.write(content)
    return out.getvalue()


class Package:
    """Members of a ZIP file by range. ``read(start, length)`` gives bytes of it, ``size`` is its length."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            where = tail_at + at - 20
            locator = read(where, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (where,) = struct.unpack_from("<Q", locator, 8)
            end = read(where, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = read(start, length), 0
        for _ in range(n):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, crc = struct.unpack_from("<H", directory, p + 10)[0], struct.unpack_from("<I", directory, p + 16)[0]
            packed, full, a, b, c = struct.unpack_from("<IIHHH", directory, p + 20)
            (local,) = struct.unpack_from("<I", directory, p + 42)
            name, extra = directory[p + 46 : p + 46 + a].decode(), directory[p + 46 + a : p + 46 + a + b]
            e = 0
            while e + 4 <= len(extra):
                tag, size_ = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: those values that have no room in the entry, in this order
                    values = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, e + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                e += 4 + size_
            self.members[name] = (method, crc, packed, local)
            p += 46 + a + b + c

    def place(self, name: str) -> tuple[int, int]:
        """Start and length of a stored member's content."""
        method, _, packed, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        a, b = struct.unpack_from("<HH", head, 26)
        return local + 30 + a + b, packed

    def member(self, name: str) -> bytes:
        start, length = self.place(name)
        content = self.read(start, length)
        if zlib.crc32(content) != self.members[name][1]:
            raise ValueError(f"{name} is damaged")
        return content

    def records(self, together: int = 4 * 1024 * 1024) -> Iterator[bytes]:
        """Records in the index's order; neighbours are read in one range of about ``together`` bytes."""
        start, length = self.place(DATA)
        group: list[tuple[int, int]] = []
        for line in [*self.member(INDEX).splitlines(), None]:
            at = json.loads(line) if line else None
            if group and (at is None or at["offset"] + at["length"] - group[0][0] > together or at["offset"] != sum(group[-1])):
                first, last = group[0][0], sum(group[-1])
                if last > length:
                    raise ValueError("the index points beyond its member")
                raw = self.read(start + first, last - first)
                for a, n in group:
                    yield gzip.decompress(raw[a - first : a - first + n])
                group = []
            if at is not None:
                group.append((at["offset"], at["length"]))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write packages to ``folder``; the plan of the result writes and has a row (path, n_records, n_bytes) for each."""
    pages = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "encode(coalesce(cast(html as string), ''), 'UTF-8') payload").withColumn("sha", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    first = pages.where(large).groupBy("sha").agg(F.min("page_id").alias("first"))
    both = pages.join(first, "sha", "left").select("page_id", "url", "payload", F.when(large & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        data, index, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal data, index, held
            name = f"{uuid.uuid4().hex}.zip"
            content = package(b"".join(data), b"".join(index))
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            done = pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(data)], "n_bytes": [len(content)]})
            data, index, held = [], [], 0
            return done

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                body = payload.as_py()
                raw = gzip.compress(record(page.as_py(), url.as_py(), body, digest(body), refers.as_py()), 4, mtime=0)
                index.append(json.dumps({"page_id": page.as_py(), "offset": held, "length": len(raw)}).encode() + b"\n")
                data.append(raw)
                held += len(raw)
                if held >= ROLL:
                    yield flush()
        if data:
            yield flush()

    return both.mapInArrow(run, "path string, n_records long, n_bytes long")


def read(packages: DataFrame, folder: str) -> DataFrame:
    """A row per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is compared with its digest. A revisit's length is that of the response it refers to, and
    both must have the same digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as f:
                    rows: list[tuple] = []
                    for raw in Package(lambda a, n, f=f: f.read_at(n, a), f.size()).records():
                        head, payload, stated = parse(raw)
                        sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                        if kind == "response" and (digest(payload) != sha or len(payload) != stated):
                            raise ValueError(f"{name}: a payload is damaged")
                        page = head["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
                        rows.append((int(page) if page else None, stated if kind == "response" else None, sha, kind, int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    found = packages.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = written(found, shared_dir(packages.sparkSession, "warc-records"))
    sizes = found.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("sha")).agg(F.max("payload_bytes").alias("size"))
    resolved = found.where("record_type = 'revisit'").join(sizes, F.col("payload_digest") == F.col("sha"), "left")
    resolved = resolved.select("page_id", F.coalesce("size", F.raise_error(F.lit("a revisit without its response")).cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return found.where("record_type = 'response'").unionByName(resolved)
