"""Operator 5: best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Which lengths share a sequence is worked out on counts of lengths, at most ``capacity`` numbers however many
documents there are: a bin is filled greedily with the largest length that fits, then its smallest piece is
replaced by two unpacked pieces that fit the gap it leaves more tightly; the pattern so found is repeated as long
as its lengths last. Pieces are then dealt to the patterns' places by their number among the pieces of their
length, so no task sees more than its own pieces.

Defined results: a null text is empty, and an empty one is the end id alone; documents longer than ``capacity`` are
cut so that only their first piece is shorter; equal rows are packed each; an empty table gives an empty result;
other columns are not read. Sequence ids and places depend on the input's partitions, the number of sequences does
not.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import encoder

CAPACITY = 1024
END_ID = 2


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), in the order in which they are packed."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        used, gap = Counter(), capacity
        while True:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            n = int(min(left[length], gap // length))
            used[length] += n
            left[length] -= n
            gap -= n * length
        while gap:
            small = min(used)
            pair = _two(left, small, small + gap)
            if not pair:
                break
            used[small] -= 1
            left[small] += 1
            used += Counter()  # drops zeros
            for length in pair:
                used[length] += 1
                left[length] -= 1
            gap -= sum(pair) - small
        more = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= more * n
        out.append((tuple(sorted(used.elements(), reverse=True)), 1 + more))
    return out


def _two(left: np.ndarray, least: int, room: int) -> tuple[int, int] | None:
    """Two available lengths whose sum is the largest that is over ``least`` and at most ``room``."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return None
    below = np.full(room + 1, 0)  # the largest available length up to each number
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    second = below[room - lengths]
    same = (second == lengths) & (left[lengths] < 2)
    second[same] = below[np.maximum(lengths[same] - 1, 0)]
    total = np.where(second > 0, lengths + second, 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(second[best])) if total[best] > least else None


class Places:
    """Where the n-th piece of each length goes, from a plan of patterns."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        found: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        base, dealt = 0, Counter()
        for pattern, times in plan:
            starts: dict[int, list[int]] = {}
            at = 0
            for length in pattern:
                starts.setdefault(length, []).append(at)
                at += length
            for length, own in starts.items():
                found.setdefault(length, []).append((dealt[length], base, len(own), own))
                dealt[length] += times * len(own)
            base += times
        self.sequences = base
        self.by_length = {}
        for length, rows in found.items():
            first, bases, n, own = zip(*rows, strict=True)
            flat = np.concatenate([np.array(o) for o in own])
            self.by_length[length] = tuple(map(np.array, (first, bases, n))) + (np.cumsum(n) - np.array(n), flat)

    def of(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for one in np.unique(length):
            rows = length == one
            first, bases, n, where, flat = self.by_length[int(one)]
            k = np.searchsorted(first, nth[rows], side="right") - 1
            r = nth[rows] - first[k]
            seq[rows], offset[rows] = bases[k] + r // n[k], flat[where[k] + r % n[k]]
        return seq, offset


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with __part and __nth: its number among its task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, piece, start, length, crc, nth, ids_out = [], [], [], [], [], [], []
            for k, ids in enumerate(enc.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                a, b = 0, (len(ids) - 1) % capacity + 1
                while a < len(ids):
                    raw, n = ids[a:b].tobytes(), b - a
                    rows.append(k)
                    piece.append(-(-a // capacity))
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(raw))
                    nth.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        ids_out.append(raw)
                    a, b = b, b + capacity
            cols = {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), **{n: pa.array(c, pa.int64()) for n, c in (("piece", piece), ("start", start), ("length", length), ("ids_crc32", crc), ("__nth", nth))}}
            cols["__part"] = pa.array(np.full(len(rows), part), pa.int64())
            if with_ids:
                cols["ids"] = pa.array(ids_out, pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = docs.select("doc_id").schema
    for n in ("piece", "start", "length", "ids_crc32", "__nth", "__part"):
        schema = schema.add(n, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("ids", "binary") if with_ids else schema)


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian uint32)."""
    with Workspace(spark, "pack") as ws:
        cut = ws.stage(pieces(docs, path, capacity, end_id, with_ids))
        sums = ws.stage(cut.groupBy("length", "__part").agg(F.count("*").alias("n")))
        counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
        places = spark.sparkContext.broadcast(Places(best_two_fit(counts, capacity)))
        before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
        numbered = cut.join(bases, ["length", "__part"]).withColumn("__nth", F.col("__nth") + F.col("__base")).select(*[c for c in cut.columns if c != "__part"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seq, offset = places.value.of(batch.column("length").to_numpy(), batch.column("__nth").to_numpy())
                keep = [n for n in batch.schema.names if n != "__nth"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

        return ws.keep(numbered.mapInArrow(run, numbered.drop("__nth").schema.add("sequence_id", "long").add("offset", "long")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from a packing with ids; at most ``capacity`` tokens meet in a group."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
