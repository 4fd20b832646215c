"""WARC archives in seekable Zstandard bundles, written and read by tasks.

A bundle is a file of independent Zstandard frames of about a megabyte of
records each, closed by a seek table in a skippable frame (the public seekable
format). The index maps a record to (bundle, frame, offset in the frame's
content, length), so one record costs one frame.

Duplicates: of records with equal payloads of at least ``min_bytes`` bytes,
the one with the largest id is a response, the others are revisits that refer
to it. Ids per digest are pre-aggregated; no task holds a digest's pages.

Bundles go to the cluster's shared folder under names of their own for every
attempt, and only complete files get their final name. The index is written
once, so it names just the files of attempts that succeeded.

Defined results
---------------
* Null html: an empty payload. Payloads under ``min_bytes`` are responses.
* Repeated ids: every row with the largest id of its digest is a response.
  An id that is null is never preferred; a digest with null ids only has
  responses only.
* A null url becomes ``urn:unknown``; blanks and line ends are escaped.
* Any length of payload works: a record over a megabyte fills its own frame.
* An empty table gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, new_path, table, text_batches, tidy

MIN_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Bytes of records that a task reads back.
READ_BYTES = 64 << 20
#: Digests with copies are broadcast up to this many (about 60 bytes each).
BROADCAST_DIGESTS = 200_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, record_offset long, record_bytes long"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit keeps the HTTP header, with the full length, alone."""
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:unknown"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_record(record: bytes) -> tuple:
    """(page_id, payload bytes, hex digest, type, refers_to); the digest of a payload that is there is computed from it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload and headers differ")
    refers_to = _from_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _from_urn(fields["WARC-Record-ID"]), size, digest, kind, refers_to


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed size) of each frame, from the bundle's end."""
    stream.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", stream.read(8 * n))
    out, at = [], 0
    for i in range(n):
        out.append((at, sizes[2 * i], sizes[2 * i + 1]))
        at += sizes[2 * i]
    return out


class _Bundle:
    """A bundle as it is written; ``add`` gives the record's place."""

    def __init__(self, folder: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{path}/{self.name}"
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.frame, self.frame_bytes, self.bytes, self.sizes = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.frame_bytes and self.frame_bytes + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.frame_bytes, len(record)
        self.frame.append(record)
        self.frame_bytes += len(record)
        self.bytes += len(record)
        return place

    def flush(self) -> None:
        if self.frame:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.frame_bytes))
            self.frame, self.frame_bytes = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``records`` (page_id, url, html, digest, record_type, refers_to); returns the index, already written itself."""
    text_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or _Bundle(folder)
                rows.append((page_id, bundle.name, *bundle.add(to_record(page_id, url, (html or "").encode(), digest, refers_to, kind == "revisit"))))
                if bundle.bytes >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                yield _index_batch(rows)
                rows = []
        if bundle:
            bundle.close()

    cols = records.select(F.col("page_id").cast("long"), "url", "html", "digest", "record_type", F.col("refers_to").cast("long"))
    return materialize(cols.mapInArrow(tidy(run), INDEX), "warc-index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "bundle", "frame", "record_offset", "record_bytes"])


class Reader:
    """Records of the bundles in a folder; keeps one seek table and one frame."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.name, self.stream, self.at = None, None, None

    def record(self, bundle: str, frame: int, offset: int, size: int) -> bytes:
        if bundle != self.name:
            if self.stream:
                self.stream.close()
            path = f"{self.path}/{bundle}"
            self.stream = self.fs.open_input_file(path)
            self.table = seek_table(self.stream, self.fs.get_file_info(path).size)
            self.name, self.at = bundle, None
        if frame != self.at:
            start, packed, full = self.table[frame]
            self.stream.seek(start)
            self.content = zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=full)
            self.at = frame
        return self.content[offset : offset + size]


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the indexed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            rows = [from_record(reader.record(*place)) for place in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # dealt by what the tasks will read, not by the size of the index
    n = index.agg(F.coalesce(F.sum("record_bytes"), F.lit(0))).first()[0] // READ_BYTES
    near = index.repartition(max(int(n), index.sparkSession.sparkContext.defaultParallelism), "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset")
    return near.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def classify(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("_bytes"))
    copies = pages.where(F.col("_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    copies = materialize(copies.where("_n > 1 and _last is not null").select("digest", "_last"), "warc-copies")
    few = copies.count() <= BROADCAST_DIGESTS
    joined = pages.join(F.broadcast(copies) if few else copies, "digest", "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")) & (F.col("_bytes") >= min_bytes)
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write(classify(table(spark, sf_dir, "pages")), folder)
    return read(index, folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d
"""
