"""Sidecar files of images as WARC records, one gzip member each, and a sequential reader of such archives."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.llm.common import TaskFile, filesystem

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
MANIFEST = "file string, records long, bytes long"
RECORDS = """image_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, valid boolean,
payload binary"""

COLUMNS = ["image_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "valid", "payload"]
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(key: str | None, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit with the HTTP head only.  The full payload's length and the keys stand
    in extension fields, which readers that don't know them pass over."""
    digest = base32_sha1(payload)
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {uri} {digest}')}>"),
              ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
              ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(block)))]
    if uri is not None:
        fields.append(("WARC-Target-URI", uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if key is not None:
        fields.append(("X-Image-ID", key))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Image-ID", refers_to)]
    head = CRLF.join([b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in fields]])
    return head + CRLF + CRLF + block + CRLF + CRLF


def write_archive(sidecars: DataFrame, folder: str, image_id: str = "image_id", uri: str = "uri", content: str = "content",
                  least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> list[tuple[str, int, int]]:
    """Write sidecars (image_id, uri, content) to `folder`, one archive per task, and give (file, records, bytes) per archive.

    Of records with equal payloads of at least `least_bytes` bytes the one with the smallest image_id is a response and the
    others are revisits that refer to it; shorter payloads are all responses.  Rows that share that smallest id are all responses;
    null ids never are referred to (alone among themselves they are responses).  Null content is an empty payload.  The payload is
    shuffled once, on its digest, by a join whose hot keys adaptive execution can split; each archive is renamed into place when
    whole.  An empty table may write archives without records.  Further columns are ignored.
    """
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = sidecars.select(F.col(image_id).alias("key"), F.col(uri).cast("string").alias("uri"), data.alias("payload"), F.sha1(data).alias("digest"))
    long_enough = F.octet_length(data) >= least_bytes
    groups = (sidecars.where(long_enough).groupBy(F.sha1(data).alias("digest"))
              .agg(F.min(image_id).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    joined = rows.join(groups, "digest", "left").select(
        F.col("key").cast("string").alias("key"), "uri", "payload",
        F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes),
               F.col("first").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, count = None, 0
        for batch in batches:
            for row in range(batch.num_rows):  # one record at a time, so a task holds little beyond its batch
                key, address, payload, refers_to = (column[row].as_py() for column in batch.columns)
                if file is None:
                    file = TaskFile(folder, ".warc.gz")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(key, address, payload, refers_to, date))
                file.write(member + packer.flush())
                count += 1
        if file is not None:
            yield pa.RecordBatch.from_pydict({"file": [file.close()], "records": [count], "bytes": [file.size]})

    # One row per written archive.
    return sorted((r.file, r.records, r.bytes) for r in joined.mapInArrow(write, MANIFEST).collect())


class SequentialReader:
    """Records of one archive stream in order.  Compressed bytes are taken chunk by chunk and inflated member by member; nothing but
    the current record is held.  A member must hold one whole record, framed by its Content-Length."""

    def __init__(self, stream, name: str = "archive"):
        self.stream, self.name = stream, name

    def members(self) -> Iterator[bytes]:
        rest, at = b"", 0
        while True:
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof:
                if not rest:
                    rest = self.stream.read(CHUNK)
                    if not rest:
                        break
                parts.append(inflate.decompress(rest))
                at += len(rest) - len(inflate.unused_data)
                rest = inflate.unused_data
            if not parts:
                return
            if not inflate.eof:
                raise ValueError(f"{self.name}: member cut off near byte {at}")
            yield b"".join(parts)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for member in self.members():
            head, mark, rest = member.partition(CRLF + CRLF)
            lines = head.split(CRLF)
            if not mark or not lines[0].startswith(b"WARC/1."):
                raise ValueError(f"{self.name}: no WARC head")
            fields = {}
            for line in lines[1:]:
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            length = int(fields["content-length"])
            if rest[length:] != CRLF + CRLF:
                raise ValueError(f"{self.name}: content length {length} does not frame the record")
            yield fields, rest[:length]


def read_archive(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]], payloads: bool = True) -> DataFrame:
    """Read the archives back, each by one task and in sequence; image ids come back as text.

    `payload` is null for revisits (and everywhere without `payloads`); payload_bytes and payload_digest always are those of the
    full payload.  `valid` tells whether the digests of the block and, in a response, of the payload fit the bytes.  A cut or
    unframed record raises with the archive's name.  An empty manifest gives an empty table.
    """
    files = spark.createDataFrame([(f,) for f, _, _ in manifest], "file string").repartition(max(1, len(manifest)))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], COLUMNS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, base = filesystem(folder)
                with store.open_input_stream(f"{base}/{name}") as stream:
                    rows, held = [], 0
                    for fields, block in SequentialReader(stream, name):
                        payload = block.partition(CRLF + CRLF)[2] if fields["warc-type"] == "response" else None
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        valid = fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (
                            payload is None or base32_sha1(payload) == digest and len(payload) == int(fields["x-payload-length"]))
                        address = fields.get("warc-target-uri")
                        if address is not None:
                            address = address.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((fields.get("x-image-id"), address, fields["warc-type"], int(fields["x-payload-length"]), digest,
                                     fields.get("x-refers-to-image-id"), valid, payload if payloads else None))
                        held += len(block)
                        if held > 16 * CHUNK or len(rows) >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    return files.mapInArrow(read, RECORDS)


