"""Web archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at
a bundle's end holds the seek table (sizes of all frames), and an index table maps
each record to its bundle, frame and place in the frame. A record is fetched by
decompressing one frame.

Payloads that repeat are stored once: the record with the smallest id is the
response, and the others are revisit records that refer to it.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, stored

#: A frame is closed once it holds so many bytes; a larger record has a frame of its own.
FRAME_BYTES = 256 << 10
#: Payloads below this size are never deduplicated.
LEAST_PAYLOAD = 100
#: Digests of 64 letters and ids that are broadcast at most, some 20 MB.
MOST_BROADCAST = 200_000
# Fixed values of the seekable format: the magic of a skippable frame, and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_URN = "urn:x-page:"


def _uri(url: str | None) -> str | None:
    """A URL with what may not stand in a header line percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) holds the HTTP header alone, with the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page_id}>", f"WARC-Date: {DATE}"]
    if (target := _uri(url)) is not None:
        head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """What a record says: record_id, type, url, digest, refers_to, size of the full payload, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = lambda x: x[len(_URN) + 1 : -1] if x else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "record_id": own(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "url": fields.get("WARC-Target-URI"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "refers_to": own(fields.get("WARC-Refers-To")),
        "size": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """Frames of records, and the seek table at the end."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 6):
        import zstandard

        self.sink, self.most = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.held = bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        """The frame that takes the record, and its place there."""
        if self.held and len(self.held) + len(record) > self.most:
            self._flush()
        at = len(self.sizes), len(self.held)
        self.held += record
        return at

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.held))
        self.sink.write(packed)
        self.sizes.append((len(packed), len(self.held)))
        self.held = bytearray()

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Frames of a bundle by number, found through the seek table in its footer."""

    def __init__(self, source):
        import zstandard

        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("no seek table that this reader knows")
        source.seek(size - 9 - 8 * n)
        table = source.read(8 * n)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.source.seek(self.starts[k])
            self.last = k, self.zstd.decompress(self.source.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])
        return self.last[1]


def with_roles(pages: DataFrame, id_col: str, html_col: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): refers_to is null for a response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = pages.withColumn("payload", payload).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # narrow rows find the payloads that occur twice; payloads themselves travel only where those are very many, and then adaptive execution can split a hot one
    firsts = stored(keyed.where(F.col("size") >= least).groupBy("digest").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "copies")
    joined = keyed.join(F.broadcast(firsts) if firsts.count() <= MOST_BROADCAST else firsts, "digest", "left")
    other = F.col("first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first"))
    return joined.select(id_col, "url", F.when(~other, F.col("payload")).alias("payload"), "size", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD, frame_bytes: int = FRAME_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages; returns the index (record_id, bundle, frame, offset, length).

    A null html is an empty payload; rows that share the smallest id of equal
    payloads are all responses; a null id never is a response that others refer to,
    if any other has its payload. A null url leaves the header out. An empty table
    gives no bundle. Other columns play no part. A bundle's name has its task's
    try, and the index names the bundles that count, so tries don't collide.
    """

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        sink = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)  # else the name decides
                writer = BundleWriter(sink, frame_bytes)
            rows = []
            for page, url, payload, size, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(6))):
                raw = record_bytes(page, url, payload, size, digest, refers)
                rows.append((page, name, *writer.add(raw), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()
            sink.close()

    source = with_roles(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "id", "html", least)
    text = source.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "payload", "size", "digest", F.col("refers_to").cast("string"))
    return stored(text.mapInArrow(write, "record_id string, bundle string, frame int, offset long, length long"), "warc-index")


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point to: (record_id, record_type, url, digest, refers_to, size, payload)."""
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("size", pa.int64()), ("payload", pa.binary())]

    def read(batches):
        fs, root = filesystem(folder)
        name, reader = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some, out = batch.slice(lo, 512), []
                for bundle, frame, offset, length in zip(*(some.column(k).to_pylist() for k in ("bundle", "frame", "offset", "length"))):
                    if bundle != name:
                        name, reader = bundle, BundleReader(fs.open_input_file(f"{root}/{bundle}"))
                    out.append(parse_record(reader.frame(frame)[offset : offset + length]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in fields], [k for k, _ in fields])

    return index.select("bundle", "frame", "offset", "length").mapInArrow(read, "record_id string, record_type string, url string, digest string, refers_to string, size long, payload binary")


def payload_digest() -> Column:
    """Of a fetched record: recomputed from a response's payload, as stated for a revisit."""
    return F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))


def payload_size() -> Column:
    return F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("size"))
