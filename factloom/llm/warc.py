"""Operator 9: WARC archives, and a chunked record table read from them.

``write_archives`` stores a record per page, each its own gzip member, streamed in slices. Pages whose payloads are
equal and at least ``min_bytes`` long become revisits of the one with the smallest page_id; a revisit keeps the HTTP
headers (with the full payload's length) and the payload's digest, not the payload. ``read_archives`` streams the
files: it holds one piece of ``chunk_bytes`` at a time, whatever a record's size, and gives a row per piece (record
id, chunk number, offset, data), with the SHA-256 carried from piece to piece and stated in the record's last row.

Defined results: null html is empty; null urls are left out of the record; control characters in urls are
percent-encoded; equal page_ids with equal payloads are both responses if theirs is the smallest; a null page_id
counts as larger than all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, open_fs

MIN_BYTES = 100
CHUNK_BYTES = 1 << 20
SLICE = 1 << 16
LEVEL = 3
#: Pages carry no time of capture, so all records state this one.
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

CHUNK_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, chunk_no long, chunk_offset long, data binary, "
    "last boolean, payload_bytes long, payload_digest string, digest_ok boolean"
)


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url}')}>"


def with_references(ws: Workspace, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    The first page of each payload is found by a partial aggregation. Both sides of the join are plain shuffles,
    which Spark splits where a payload has very many copies.
    """
    given = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    given = given.withColumn("digest", F.sha2("payload", 256))
    long = given.where(F.octet_length("payload") >= min_bytes)
    first = ws.stage(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    joined = given.join(first, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


class Writer:
    """Writes gzip members to an open file, a record each, in slices."""

    def __init__(self, out):
        self.out = out

    def record(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        body = payload if refers_to is None else b""
        head = [
            "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url or '')}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
        ]
        if url is not None:
            head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
        if page_id is not None:
            head.append(f"Page-ID: {page_id}")
        if refers_to is not None:
            head += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))
        view = memoryview(body)
        for i in range(0, len(view), SLICE):
            self.out.write(packer.compress(view[i : i + SLICE]))
        self.out.write(packer.compress(b"\r\n\r\n") + packer.flush())


class Inflated:
    """The bytes of a file of gzip members, read with a bounded buffer."""

    def __init__(self, file):
        self.file, self.unpacker, self.rest, self.buffer, self.over = file, None, b"", bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            raw = self.rest or self.file.read(SLICE)
            self.rest = b""
            if not raw:
                self.over = True
                if self.unpacker is not None and not self.unpacker.eof:
                    raise ValueError("the archive ends within a member")
                break
            if self.unpacker is None or self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(raw, SLICE * 4)
            self.rest = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if out:
                self.buffer += out
                return True
        return False

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the file."""
        while (i := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 2]
        return out

    def take(self, n: int) -> bytes:
        """Exactly n bytes."""
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _headers(source: Inflated) -> dict[str, str]:
    out = {}
    while line := source.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(file, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from an open archive."""
    source = Inflated(file)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = _headers(source)
        left = int(head["content-length"])
        status = source.line() or b""
        http, used = {}, len(status) + 2
        while line := source.line():
            used += len(line) + 2
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http[name.strip().lower()] = value.strip()
        left -= used + 2
        known = head["warc-payload-digest"].partition(":")[2]
        page, first = head.get("page-id"), head.get("refers-to-page-id")
        base = (head["warc-record-id"], page and int(page), head["warc-type"], first and int(first))
        if head["warc-type"] == "revisit":
            yield (*base, 0, 0, b"", True, int(http["content-length"]), known, None)
        else:
            sha, at, k = hashlib.sha256(), 0, 0
            while True:
                data = source.take(min(chunk_bytes, left - at))
                sha.update(data)
                last = at + len(data) == left
                yield (*base, k, at, data, last, left if last else None, sha.hexdigest() if last else None, sha.hexdigest() == known if last else None)
                at, k = at + len(data), k + 1
                if last:
                    break


def write_archives(referenced: DataFrame, uri: str) -> DataFrame:
    """Writes a file per task; returns (file, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, None
        for batch in batches:
            if out is None:
                fs, folder = open_fs(uri)
                fs.create_dir(folder, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
                own = f"{folder}/{name}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own, compression=None)
                writer = Writer(out)
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                writer.record(*(x.as_py() for x in row))
                n += 1
        if out is not None:
            out.close()
            fs.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

    return referenced.mapInArrow(run, "file string, n_records long")


def read_archives(manifest: DataFrame, uri: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the files of a manifest (columns of CHUNK_SCHEMA)."""
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in CHUNK_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(uri)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as f:
                    for row in records(f, chunk_bytes):
                        rows.append(row if with_data else (*row[:6], None, *row[7:]))
                        held += len(row[6]) * with_data
                        if len(rows) >= 5000 or held >= 4 * chunk_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, CHUNK_SCHEMA)


def archive_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder, reads the archives back, and returns a row per record."""
    with Workspace(spark, "warc") as ws:
        uri = f"{ws.uri}/files"
        manifest = ws.stage(write_archives(with_references(ws, pages), uri))
        chunks = read_archives(manifest, uri, with_data=False).where("last")
        return ws.keep(chunks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"))
