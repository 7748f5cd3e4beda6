"""Operator 8: token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending doc_id order. Its frames each hold the ids (little-endian uint32) of whole
documents, about ``frame_bytes`` of them (a longer document has a frame of its own); a further frame holds the
documents' index (doc_id, whether it is null, ids, frame); a skippable frame ends the file with the seek table of
the public seekable format: compressed size, decompressed size and checksum (low half of XXH64) of each frame. Any
zstandard reader can read the file as a whole; ``read_documents`` fetches and decompresses only the frames that
hold the requested documents.

Files are written under a name of their own and then moved into place, so tasks that run again or twice do no harm.

Defined results: a null text is empty, and an empty one is the end id alone; equal doc_ids come in the order of
their texts; a null doc_id comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, open_fs
from .tokens import encoder

END_ID = 1
FRAME_BYTES = 1 << 18
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4"), ("frame", "<u4")])


class Writer:
    """Writes documents to an open file; only one frame is held at a time."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[np.ndarray] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.n_docs = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.open_bytes + len(ids) > self.frame_bytes:
            self._close(b"".join(self.open))
        self.rows.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.open_bytes += len(ids)
        self.n_docs += 1
        self.n_ids += len(ids) // 4

    def _close(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.open_bytes = [], 0
        self.index.append(np.array(self.rows, _INDEX))
        self.rows = []

    def finish(self) -> None:
        if self.open:
            self._close(b"".join(self.open))
        self._close(b"".join(x.tobytes() for x in self.index))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Random access to the documents of an open, seekable file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.cumsum(self.table[:, 0], dtype=np.int64) - self.table[:, 0]
        self.decompressor = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.frame(n - 1), _INDEX)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = map(int, self.table[k])
        self.file.seek(int(self.starts[k]))
        raw = self.decompressor.decompress(self.file.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in order, of all documents or of the wanted ones; other frames are not read."""
        rows = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["doc_id"], list(wanted)) & (self.index["null"] == 0))
        sizes = 4 * self.index["n"].astype(np.int64)
        at = np.cumsum(sizes) - sizes
        first = {}  # place of each frame's first document
        for f, i in zip(*np.unique(self.index["frame"], return_index=True), strict=True):
            first[int(f)] = int(at[i])
        held, raw = -1, b""
        for i in rows:
            f = int(self.index["frame"][i])
            if f != held:
                held, raw = f, self.frame(f)
            a = int(at[i]) - first[f]
            yield None if self.index["null"][i] else int(self.index["doc_id"][i]), raw[a : a + int(sizes[i])]


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes a file per task; returns (part, file, n_docs, n_ids). Parts are in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if writer is None:
                enc, (fs, folder) = encoder(path), open_fs(uri)
                fs.create_dir(folder, recursive=True)
                name = f"part-{part:06d}.ids.zst"
                own = f"{folder}/{name}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own, compression=None)
                writer = Writer(out, frame_bytes)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, uri: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of a manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.binary())] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(uri)
        for batch in batches:
            for row in batch.to_pylist():
                at, rows, held = row["base"], [], 0
                with fs.open_input_file(f"{folder}/{row['file']}") as f:
                    for doc_id, ids in Reader(f).documents():
                        rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), ids))
                        at += len(ids) // 4
                        held += len(ids) * with_ids
                        if len(rows) >= 10_000 or held >= 1 << 24:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return based.select("file", "base").repartition(files).mapInArrow(run, schema)


def read_documents(uri: str, file: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents of one file, for readers outside Spark."""
    fs, folder = open_fs(uri)
    with fs.open_input_file(f"{folder}/{file}") as f:
        return {d: np.frombuffer(ids, "<u4") for d, ids in Reader(f).documents(wanted)}


def token_report(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Writes all documents to token files in the shared folder, and returns what reading them back gives."""
    with Workspace(spark, "tokens") as ws:
        uri = f"{ws.uri}/files"
        manifest = ws.stage(write_token_files(docs, uri, path))
        return ws.keep(read_token_files(manifest, uri))
