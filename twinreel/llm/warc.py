"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of whole records and
of ``frame_bytes`` or so of plain data, then two skippable frames: a record
index, which maps every record id to its frame and its offset in the plain
data of that frame, and the seek table of the Zstandard seekable format, whose
footer ends the bundle.  To read a record, take the footer, the table and the
index, and decompress one frame.

Bundles are rows of a written table (``name``, ``content``), since executors
share only what Spark writes; :func:`export` puts them into files.  A bundle's
name follows from its first record, so a task that runs again writes the same.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with
the smallest id is a response and the others are revisits that name it.  A
null payload is empty.  Rows that repeat an id and payload are all written; if
they are the smallest, each is a response.  An empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_or_empty

MIN_REVISIT = 100
#: Plain bytes after which a frame ends, and compressed ones that end a bundle.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20

#: Payloads that several records have, up to which their digests go to every task.
FEW_DIGESTS = 200_000

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1

#: All records carry one date: the table has none, and files should not differ from run to run.
DATE = "1970-01-01T00:00:00Z"


def record(page: int, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its length and digest."""
    body = b"" if refers is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(url.split()),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=6), frame_bytes
        self.frames: list[bytes] = []
        self.plain_sizes: list[int] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, page: int, data: bytes) -> None:
        self.index.append((page, len(self.frames), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.plain_sizes.append(len(self.open))
            self.size += len(self.frames[-1])
            self.open = bytearray()

    def finish(self) -> bytes:
        self.end_frame()
        index = self.zstd.compress(b"".join(struct.pack("<qIIQ", *entry) for entry in self.index))
        skip = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = [(len(f), n) for f, n in zip(self.frames, self.plain_sizes, strict=True)] + [(len(skip), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + skip + struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table


class BundleReader:
    """Reads single records of a bundle."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.zstd = content, zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("not a seekable bundle")
        at, self.frames = 0, []
        for packed, plain in struct.iter_unpack("<II", content[-9 - 8 * count : -9]):
            self.frames.append((at, packed, plain))
            at += packed
        at, packed, _ = self.frames.pop()
        index = self.zstd.decompress(content[at + 8 : at + packed])
        self.index = [*struct.iter_unpack("<qIIQ", index)]
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.frames[number]
            self.last = (number, self.zstd.decompress(self.content[at : at + packed], max_output_size=plain))
        return self.last[1]

    def at(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """Header fields and body of the record at a place of the index."""
        data = self.frame(frame)[offset : offset + length]
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        return fields, rest[: int(fields["Content-Length"])]

    def find(self, page: int) -> Iterator[tuple[dict[str, str], bytes]]:
        for found, *place in self.index:
            if found == page:
                yield self.at(*place)


BUNDLES = pa.schema([("name", pa.string()), ("content", pa.binary()), ("records", pa.int64()), ("frames", pa.int64())])
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int32()), ("record_bytes", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Bundles of all rows as a table in shared storage: ``name, content,
    records, frames``."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text_or_empty(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    first = materialize(
        rows.where(f"n >= {MIN_REVISIT}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
        .select(F.col("digest").alias("of"), "first"), "warc-first"
    )
    few = first.count() <= FEW_DIGESTS  # then no payload has to move
    roles = rows.join(F.broadcast(first) if few else first, (F.col("digest") == F.col("of")) & (F.col("n") >= MIN_REVISIT), "left")
    roles = roles.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def done() -> pa.RecordBatch:
            nonlocal writer
            content = writer.finish()
            name = f"pages-{writer.index[0][0]}-{hashlib.sha256(content).hexdigest()[:16]}.warc.zst"
            out = pa.RecordBatch.from_pydict({"name": [name], "content": [content], "records": [len(writer.index)], "frames": [len(writer.frames)]}, schema=BUNDLES)
            writer = BundleWriter()
            return out

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(page if page is not None else -(1 << 63), record(page, url, html.encode(), digest, refers))
                if writer.size >= BUNDLE_BYTES:
                    yield done()
        if writer.index:
            yield done()

    bundles = materialize(map_arrow(roles, pack, "name string, content binary, records bigint, frames bigint"), "warc-bundles")
    discard(first)
    return bundles


def read(bundles: DataFrame) -> DataFrame:
    """What each record of the bundles says, with its place: ``page_id, bundle,
    frame, frame_offset, record_bytes, url, record_type, payload_bytes,
    payload_digest, refers_to``.  A response's payload is digested anew."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, out = BundleReader(content), []
                for page, frame, offset, length in reader.index:
                    fields, body = reader.at(frame, offset, length)
                    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response":
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    out.append((None if page == -(1 << 63) else page, name, frame, offset, length, fields["WARC-Target-URI"], kind, size, digest, refers and int(refers[10:-1])))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)

    schema = "page_id bigint, bundle string, frame int, frame_offset int, record_bytes bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return map_arrow(bundles.select("name", "content"), unpack, schema)


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Write bundles one by one to a folder of the driver; returns the names."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for row in bundles.select("name", "content").toLocalIterator():
        Path(folder, row["name"]).write_bytes(row["content"])
        names.append(row["name"])
    return names
