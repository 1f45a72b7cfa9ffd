"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing: each task writes one archive below the shared folder under a name of
its own attempt; only names that the finished job reports are read, so a lost
or repeated attempt leaves nothing behind that counts. Equal payloads (by
SHA-1) are stored once, as the response of the largest page_id; the others are
revisit records that name it.

Reading: an archive is cut into byte ranges. A task scans its range for the
gzip magic, takes a place for a record only if the member decodes to a WARC
header there, and owns the records that start inside its range, reading past
the end to finish the last one.

Defined cases: null html is an empty payload; empty payloads are equal to one
another; rows of equal page_id and payload are separate records, the first
(in sorted order) of them may be the response; payloads of any length are
written and read whole; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.llm.common import scratch_dir, text_batches

#: Bytes of a range, and of one read.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Smallest payload that a revisit record may stand for.
MIN_REVISIT_BYTES = 0
MAGIC = b"\x1f\x8b\x08"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a folder's URI (file, hdfs, s3, gs) and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP headers and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> (path, bytes) of the archives written, one a task. Runs once, when it returns."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    first = p.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = p.join(first, "sha", "left").drop("sha")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        path, size, out = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, None
        # Of repeated rows of the response's page_id all are written as responses: each is that record.
        for part, texts in text_batches(batches, "html"):
            ids, urls, firsts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "response_id"))
            out = out or fs.open_output_stream(path, compression=None)
            for page_id, url, html, to in zip(ids, urls, texts, firsts, strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                size += out.write(record(page_id, url, payload, digest_of(payload), None if to is None or to == page_id else to))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "bytes"])

    # One short row a task; collecting them runs the job exactly once.
    made = rows.mapInArrow(write, "path string, bytes long").collect()
    return pages.sparkSession.createDataFrame([tuple(r) for r in made], "path string, bytes long")


class RangeReader:
    """Bytes of a file by position, one piece of READ_BYTES in memory at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.base, self.data = file, 0, b""

    def piece(self, pos: int) -> memoryview:
        """Bytes from a position on; empty at the end of the file."""
        if not self.base <= pos < self.base + len(self.data):
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(READ_BYTES)
        return memoryview(self.data)[pos - self.base :]

    def find(self, what: bytes, pos: int, end: int) -> int:
        """The first place in [pos, end) at which `what` starts, or -1."""
        while pos < end:
            have = len(self.piece(pos))
            i = self.data.find(what, pos - self.base)
            if i >= 0:
                return self.base + i if self.base + i < end else -1
            if have < len(what):
                return -1
            pos = self.base + len(self.data) - len(what) + 1  # it may go on in the next piece
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(READ_BYTES)
        return -1


def member(reader: RangeReader, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at an offset and the offset after it; None if no WARC record starts there."""
    unpack = zlib.decompressobj(31)
    out, pos, valid = [], at, False
    size = 0
    while True:
        piece = reader.piece(pos)
        if not len(piece):
            return None
        piece = piece if valid else piece[:512]
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece) - len(unpack.unused_data)
        size += len(out[-1])
        if not valid and (size >= 8 or unpack.eof):
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            valid = True
        if unpack.eof:
            return b"".join(out), pos


def parse(data: bytes, with_payload: bool) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x.rsplit(":", 1)[1].rstrip(">")) if "urn:page:" in x and not x.endswith("None>") else None
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != told or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": told, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To", "")), "url": fields["WARC-Target-URI"] if "WARC-Target-URI" in fields else "", "payload": payload if with_payload and kind == "response" else None}


def records_of(fs: pafs.FileSystem, path: str, start: int, end: int, with_payload: bool) -> Iterator[dict]:
    """The records that start in [start, end) of an archive."""
    with fs.open_input_file(path) as file:
        reader, at = RangeReader(file), start
        while (at := reader.find(MAGIC, at, end)) >= 0:
            found = member(reader, at)
            if found is None:
                at += 1
                continue
            yield parse(found[0], with_payload)
            at = found[1]


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """(path, bytes) of archives -> their records, read in ranges of split_bytes."""
    splits = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, size = [], 0
                for r in records_of(fs, path, start, start + split_bytes, with_payload):
                    rows.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return splits.repartition(tasks).mapInArrow(read, SCHEMA)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes the pages' records below the shared folder and reads them back."""
    folder = scratch_dir(pages.sparkSession)
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder), with_payload=with_payload)
