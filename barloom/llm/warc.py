"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some records, followed by a skippable frame with the
sizes of all frames (the seekable format's footer), so that a reader can decompress one frame alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, scratch, text_of, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(record: str) -> int | None:
    number = record.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record at this offset as RECORD's values, and the offset behind it. A wrong digest raises."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    split = data.index(b"\r\n\r\n", begin) + 4
    http = dict(x.split(": ", 1) for x in data[begin : split - 4].decode().split("\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    payload = data[split:stop] if kind == "response" else None
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
    refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
    return (page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, refers, payload), stop + 4


class Bundle:
    """Writes one bundle; records of a frame go to it together when it is full."""

    def __init__(self, stream):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.stream, self.sizes, self.parts, self.raw, self.written = stream, [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        place = (len(self.sizes), self.raw, len(record))
        self.parts.append(record)
        self.raw += len(record)
        if self.raw >= FRAME_BYTES:
            self._frame()
        return place

    def _frame(self) -> None:
        data = b"".join(self.parts)
        frame = self.compress(data)
        self.stream.write(frame)
        self.written += len(frame)
        self.sizes.append((len(frame), len(data)))
        self.parts, self.raw = [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, read from the footer."""
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    table, at, out = file.read_at(8 * n, size - 9 - 8 * n), 0, []
    for packed, raw in struct.iter_unpack("<II", table):
        out.append((at, packed, raw))
        at += packed
    return out


def _open(path: str):
    import pyarrow.fs

    fs, where = pyarrow.fs.FileSystem.from_uri(path)
    return fs, where


def read_frame(file, table: list[tuple[int, int, int]], frame: int) -> bytes:
    import zstandard

    at, packed, raw = table[frame]
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=raw)


def lookup(bundle: str, frame: int, offset: int) -> tuple:
    """One record by its place in the index; reads the footer and one frame."""
    fs, where = _open(bundle)
    with fs.open_input_file(where) as file:
        return parse_record(read_frame(file, seek_table(file, file.size()), frame), offset)[0]


def write_warc(pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to bundles in folder; returns the INDEX of the records.

    Of rows whose payloads are equal and have at least min_bytes bytes, that with the largest (page_id, url) is the
    response and the others revisit it; rows that repeat it wholly are responses too. Payloads are compared by
    SHA-1 and length. A null html is empty; a null page_id is smaller than others; a null url has no header.
    Each task writes bundles under names of its own and only those in the index count, so a task that is run again or
    twice does no harm. Only the digests of repeated payloads are gathered; beyond a checked size they are joined by
    a shuffle. Columns of pages but the three are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    html = F.col("_html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("_page"), F.col("url").alias("_url"), text_of("html").alias("_html"))
    rows = rows.withColumns({"_sha": F.unhex(F.sha1(html)), "_n": F.octet_length("_html")})
    groups = rows.filter(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.max(F.struct("_page", "_url")).alias("_top"), F.count(F.lit(1)).alias("_rows"))
    groups = maybe_broadcast(written(groups.filter("_rows > 1").drop("_rows"), "payloads"))
    marked = rows.join(groups, ["_sha", "_n"], "left").select(
        "_page", "_url", html.alias("_payload"), F.col("_top._page").alias("_refers"),
        (F.col("_top").isNotNull() & ~F.col("_top").eqNullSafe(F.struct("_page", "_url"))).alias("_revisit"),
    )

    def write(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        bundle = path = None
        for batch in batches:
            out: list[tuple] = []
            for page, url, payload, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path, bundle = f"{folder}/{name}", Bundle(fs.open_output_stream(f"{root}/{name}", compression=None))
                out.append((page, record_id(page), path, *bundle.add(make_record(page, url, payload, refers, revisit))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    return written(marked.mapInArrow(write, INDEX), "warc-index")


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The RECORDs of all bundles that the index names, read frame by frame. Without payloads, that column is null."""
    bundles = index.select("bundle").distinct()
    n = max(1, bundles.count())

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = _open(path)
                with fs.open_input_file(where) as file:
                    table = seek_table(file, file.size())
                    for frame in range(len(table)):
                        data, at, out = read_frame(file, table, frame), 0, []
                        while at < len(data):
                            record, at = parse_record(data, at)
                            out.append(record if payloads else (*record[:-1], None))
                        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return bundles.repartition(min(n, 10_000)).mapInArrow(read, RECORD)
