"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a skippable frame
that holds the sizes of all frames (the public seekable format). The index names, for each record,
the bundle, the frame and the offset inside the frame, so that one record costs one frame to read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .store import Scratch

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 128 << 20
#: Frames that a task reads, about.
TASK_FRAMES = 16
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the response's header lines and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower case), block and end of the record at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin = stop + 4
    end = begin + int(fields["content-length"])
    return fields, data[begin:end], end + 4


class Bundle:
    """Writer of one bundle."""

    def __init__(self, root: str) -> None:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}.warc.zst"
        self.out = store.open_output_stream(f"{base}/{self.path.rsplit('/', 1)[1]}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.pending, self.size, self.total = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.pending.append(data)
        self.size += len(data)
        self.total += len(data)
        return at

    def flush(self) -> None:
        if self.size:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, path: str) -> None:
        store, base = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(base)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        raw = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.start, self.sizes, at = [], [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", raw, 8 * k)
            self.start.append(at)
            self.sizes.append((packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        packed, plain = self.sizes[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.start[k]), max_output_size=plain)

    def record(self, k: int, offset: int) -> tuple[dict[str, str], bytes]:
        fields, block, _ = parse(self.frame(k), offset)
        return fields, block

    def close(self) -> None:
        self.file.close()


INDEX = "record_id string, bundle string, frame int, offset long"


def write_archives(pages: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """Write a record a page below `root`, a place that all workers share; gives the index.

    Of pages with equal payloads of at least LEAST_SHARED bytes the smallest page_id is a response,
    the others revisit it; smaller payloads are all responses. Null html: an empty payload. Null
    page_id: a record without a number, never referred to. Rows of equal page_id and payload: all
    responses where their page_id is the smallest. Other columns are not read.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    shared = scratch.keep(full.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "shared")
    marked = full.join(shared, "digest", "left").select("page_id", "url", "html", "digest", "size", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]
            html = batch.column(2)
            for k, (page, url, digest, size, first) in enumerate(zip(*columns, strict=True)):
                bundle = bundle or Bundle(root)
                revisit = first is not None and first != page
                frame, offset = bundle.add(record(page, url, html[k].as_buffer().to_pybytes(), digest, size, first, revisit))
                rows.append((f"<urn:page:{'' if page is None else page}>", bundle.path, frame, offset))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                yield pa.record_batch([pa.array(x) if k != 2 else pa.array(x, pa.int32()) for k, x in enumerate(zip(*rows, strict=True))], names=["record_id", "bundle", "frame", "offset"])
                rows = []
        if bundle:
            bundle.close()

    return scratch.keep(marked.mapInArrow(write, INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the index.

    Each frame is read once, by its place in the seek table, and each record at its offset; the
    digest of a response is that of the bytes read.
    """
    # the index is small beside what it points at, so tasks are dealt by frames and not by the index's bytes
    tasks = max(1, -(-index.select("bundle", "frame").distinct().count() // TASK_FRAMES))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "record_id")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = BundleReader(row["bundle"])
                data = reader.frame(row["frame"])
                reader.close()
                out = []
                for x in row["at"]:
                    fields, block, _ = parse(data, x["offset"])
                    if fields["warc-record-id"] != x["record_id"]:
                        raise ValueError(f"{x['record_id']} is not at its place in {row['bundle']}")
                    number = x["record_id"][len("<urn:page:") : -1]
                    cut = block.index(b"\r\n\r\n") + 4
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response":
                        size, found = len(block) - cut, hashlib.sha256(block[cut:]).hexdigest()
                        if found != digest:
                            raise ValueError(f"{x['record_id']} does not have the payload that it was written with")
                    else:
                        size = int(block[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    refers = fields.get("warc-refers-to", "")[len("<urn:page:") : -1]
                    out.append((int(number) if number else None, size, digest, fields["warc-type"], int(refers) if refers else None))
                page, size, digest, kind, refers = zip(*out, strict=True)
                yield pa.record_batch([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """What the archives of all pages hold, written to the shared folder and read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, scratch.path("bundles"), scratch))
