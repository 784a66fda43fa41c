"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames; each frame is compressed on its own, so any standard Zstandard reader can read the file from end to end.
A skippable frame at the end holds the seek table (the public "seekable format": sizes of every frame, then the footer). The index maps a record's identifier
to its archive, its frame and its offset within the frame's content, so one record costs one range read and one frame.

Records whose payloads are equal share one response record (that with the largest identifier); others are revisit records that refer to it. Digests are computed by Spark and
joined; the payload moves once. A task names its archives after an attempt of its own and lists them in the index when it ends well; files that no index row names are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Workspace, open_fs

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Content of a frame and compressed bytes of an archive, at most but for one record.
FRAME_BYTES = 256 << 10
ARCHIVE_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_uri(page_id: int | None, digest: str) -> str:
    """A record's name: a version 8 UUID that holds the identifier; without one, a version 5 UUID of the payload."""
    if page_id is None:
        return f"<{uuid.uuid5(uuid.NAMESPACE_URL, digest).urn}>"
    n = page_id & (1 << 64) - 1
    return f"<{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | n & 15).urn}>"


def page_of(uri: str) -> int | None:
    u = uuid.UUID(uri.strip("<>")).int
    if u >> 76 & 15 != 8:
        return None
    n = (u >> 80) << 16 | (u >> 64 & 0xFFF) << 4 | u & 15
    return n - (1 << 64) if n >> 63 else n


def _target(url: str | None, uri: str) -> str:
    """A header value without white space or controls; a record without url is its own target."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if url else uri.strip("<>")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, length: int) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP header alone."""
    uri = record_uri(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uri}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_target(url, uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, WARC header, HTTP header, payload) of each record of a frame's content, from offset ``at``."""
    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])

    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = fields(data[at:end])
        size = int(head["Content-Length"])
        block = data[end + 4: end + 4 + size]
        if len(block) < size or data[end + 4 + size: end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, head, fields(http), payload
        at = end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for (compressed, content) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame of an open archive of ``size`` bytes."""
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    raw = f.read_at(n * width, size - 9 - n * width)
    out, at = [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", raw, k * width)
        out.append((at, c, d))
        at += c
    return out


class BundleWriter:
    """Appends records to frames and frames to an output stream."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        at = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.flush()
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()


def assign_types(pages: DataFrame, ws: Workspace, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), digest (hex SHA-1), revisit, refers_to. Of equal payloads of at least ``least_bytes`` bytes the row with the largest page_id is the response
    (null ids last; of repeated rows one); the rest revisit it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    each = rows.groupBy("digest", "page_id").agg(F.max("url").alias("top_url"), F.count("*").alias("copies"))
    top = each.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    each = each.withColumnsRenamed({"digest": "_d", "page_id": "_p"})
    chief = top.join(each, (F.col("digest") == F.col("_d")) & F.col("refers_to").eqNullSafe(F.col("_p"))).select(F.col("digest").alias("_digest"), "refers_to", "top_url", "copies")
    chief = ws.save(chief, "chief")
    joined = rows.join(chief, rows["digest"] == chief["_digest"])
    large = F.octet_length("payload") >= least_bytes
    at_top = F.col("page_id").eqNullSafe(F.col("refers_to"))
    columns = ["page_id", "url", "payload", "digest", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to")]
    plain = joined.where(~(at_top & (F.col("copies") > 1))).withColumn("revisit", large & ~at_top)
    if chief.where("copies > 1").isEmpty():
        return plain.select(*columns)
    # Rows that repeat the largest page_id: equal rows are counted, and one of them (the largest url) is the response.
    again = joined.where(at_top & (F.col("copies") > 1)).groupBy("page_id", "url", "payload", "digest", "refers_to", "top_url").agg(F.count("*").alias("n"))
    again = again.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("revisit", large & ~(F.col("url").eqNullSafe(F.col("top_url")) & (F.col("k") == 1)))
    return plain.select(*columns).unionByName(again.select(*columns))


INDEX = "page_id long, archive string, archive_bytes long, frame int, frame_offset long, record_bytes long"


def write_archives(pages: DataFrame, ws: Workspace, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into the workspace; returns the index, one row per record.
    archive_bytes is set on an archive's first row only."""
    folder = f"{ws.path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        writer, rows, name = None, [], ""

        def done() -> pd.DataFrame:
            writer.close()
            size = writer.written + len(seek_table(writer.frames))
            out = pd.DataFrame(rows, columns=["page_id", "frame", "frame_offset", "record_bytes"]).astype({"page_id": "Int64"})
            sizes = pd.array([size] + [None] * (len(rows) - 1), dtype="Int64")
            return out.assign(archive=name, archive_bytes=sizes)[["page_id", "archive", "archive_bytes", "frame", "frame_offset", "record_bytes"]]

        for pdf in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(pdf.column(k).to_pylist() for k in range(6))):
                if writer is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes=frame_bytes)
                record = build_record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), revisit, refers_to, len(payload))
                frame, offset = writer.add(record)
                rows.append((page_id, frame, offset, len(record)))
                if writer.written >= archive_bytes:
                    yield pa.RecordBatch.from_pandas(done(), preserve_index=False)
                    writer = None
        if writer is not None:
            yield pa.RecordBatch.from_pandas(done(), preserve_index=False)

    schema = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("archive_bytes", pa.int64()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.Table.from_batches([b]).select(schema.names).cast(schema).combine_chunks().to_batches()[0]

    return ws.save(assign_types(pages, ws, least_bytes).mapInArrow(typed, INDEX), "index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index's archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits).
    A response's digest is computed from the payload that was read, and must be the one in its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = open_fs(folder)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    for at, packed, content in read_seek_table(f, size):
                        rows = [_row(*r[1:]) for r in parse_records(unpack.decompress(f.read_at(packed, at), max_output_size=content))]
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)

    archives = index.where("archive_bytes is not null").select("archive", "archive_bytes")
    archives = archives.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism))
    return archives.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(head: dict[str, str], http: dict[str, str], payload: bytes) -> dict:
    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't have its digest")
    return {
        "page_id": page_of(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "payload_digest": digest, "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
        "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def look_up(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (page_id), each by one range read of its frame."""
    sizes = index.where("archive_bytes is not null").select("archive", F.col("archive_bytes").alias("size"))
    rows = index.join(wanted.select("page_id").distinct(), "page_id").drop("archive_bytes").join(sizes, "archive").select("archive", "size", "frame", "frame_offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = open_fs(folder)
        for b in batches:
            for name, size, frame, offset in zip(*(b.column(k).to_pylist() for k in range(4))):
                with fs.open_input_file(f"{root}/{name}") as f:
                    at, packed, content = read_seek_table(f, size)[frame]
                    data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=content)
                yield pa.RecordBatch.from_pylist([_row(*next(parse_records(data, offset))[1:])], schema=RECORD_SCHEMA)

    return rows.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, **options) -> DataFrame:
    """Writes pages (page_id, url, html), reads the archives back: one row per row of pages, as read_archives gives it.

    Null html is an empty payload. Null urls become the record's own name, null page_ids stay null (such records are named by their payload). Repeated rows are records each: one response, the others revisits. Other
    columns are not looked at; no rows give no records. Long payloads are records like any other: a record lies whole in its frame, and its task holds it a few times over.
    """
    ws = Workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, ws, least_bytes, **options), f"{ws.path}/archives")
