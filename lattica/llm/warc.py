"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC
records, then a skippable frame that maps record ids to (frame, offset in the
frame's data), then a skippable frame with the seek table of the Zstandard
seekable format, so that any zstd tool can read a bundle and ``Bundle.record``
reads one record by decompressing one frame.

Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
largest page_id is stored (``response``) and the others refer to it
(``revisit``, with the HTTP header alone); smaller payloads are all stored.

Each task writes bundles of bounded size under names of its own attempt; the
table of bundles that ``write`` returns is what counts.

Defined results: null html is an empty payload; a null url has no target URI;
a null page_id is smaller than all others; rows equal in page_id and payload are
equal records; an empty table gives no bundle and no rows.  Other columns are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.scratch import new_path, open_fs, save

#: Fixed values of the Zstandard seekable format and of skippable frames.
_SEEK_MAGIC, _TABLE_FRAME, _INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = "path string, records long"
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Payload groups that a broadcast may hold (about 64 bytes each); above it the join shuffles.
BROADCAST_GROUPS = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{payload_digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """(id, bytes) of one WARC record."""
    sha = digest(payload)
    name = record_id(page_id, sha)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to, sha)}", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "none" else int(page)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    start = end + 4
    stop = start + int(headers["content-length"])
    return headers, data[start:stop], stop + 4


class Writer:
    """A bundle, written as a stream."""

    def __init__(self, folder: str, name: str, frame_bytes: int, level: int = 3):
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        self.path, self.out = f"{folder}/{name}", fs.open_output_stream(f"{inner}/{name}", compression=None)
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []
        self.buffer, self.written = bytearray(), 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), len(self.buffer)))
        self.buffer += data
        if len(self.buffer) >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer.clear()

    def close(self) -> tuple[str, int]:
        if self.buffer:
            self._flush()
        index = self.zstd.compress("\n".join(f"{n}\t{f}\t{o}" for n, f, o in self.index).encode())
        self.out.write(struct.pack("<II", _INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _TABLE_FRAME, len(table)) + table)
        self.out.close()
        return self.path, len(self.index)


class Bundle:
    """Reads a bundle: one record by id, or all in order."""

    def __init__(self, path: str):
        fs, inner = open_fs(path)
        self.file = fs.open_input_file(inner)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed
        self.index_at, self.zstd, self._index = at, zstandard.ZstdDecompressor(), None

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        return self.zstd.decompress(self.file.read_at(packed, at), max_output_size=size)

    def index(self) -> dict[str, tuple[int, int]]:
        if self._index is None:
            _, size = struct.unpack("<II", self.file.read_at(8, self.index_at))
            lines = self.zstd.decompress(self.file.read_at(size, self.index_at + 8)).decode().split("\n")
            self._index = {n: (int(f), int(o)) for n, f, o in (x.split("\t") for x in lines if x)}
        return self._index

    def record(self, name: str) -> tuple[dict[str, str], bytes]:
        k, offset = self.index()[name]
        headers, block, _ = parse(self.frame(k), offset)
        return headers, block

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parse(data, at)
                yield headers, block


def deduplicate(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (never null), keep: the largest page_id with the same payload, null where only this row has it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "utf-8"))))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    groups = save(groups, "payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    return rows.join(groups, "sha", "left").select("page_id", "url", "html", "keep")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28) -> DataFrame:
    """Write all pages; the table of bundles, kept in the shared folder."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []
        for batch in batches:
            for page_id, url, html, keep in zip(*(batch.column(k) for k in range(4)), strict=True):
                page, first = page_id.as_py(), keep.as_py()
                kind = "response" if first is None or page == first else "revisit"
                writer = writer or Writer(folder, f"{uuid.uuid4().hex}.warc.zst", frame_bytes)
                writer.add(*record(page, url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), kind, first))
                if writer.written >= bundle_bytes:
                    made.append(writer.close())
                    writer = None
        if writer:
            made.append(writer.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64()), strict=True)], names=["path", "records"])

    return save(deduplicate(pages, least_bytes).mapInArrow(task, BUNDLES), "bundles")


def read(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """A row for each record of the bundles; stored payloads are checked against their digests."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in Bundle(path):
                    sha = headers["warc-payload-digest"].removeprefix("sha1:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != size or digest(payload) != sha):
                        raise ValueError(f"{headers['warc-record-id']} in {path} is damaged")
                    first = _page(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), size, sha, kind, first))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=names)

    files = bundles.count()
    return bundles.select("path").repartition(max(1, min(files, 10_000))).mapInArrow(task, PAGES)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """write() to a new folder of the shared one, then read()."""
    spark = pages.sparkSession
    return read(spark, write(pages, new_path(spark, "warc"), least_bytes))
