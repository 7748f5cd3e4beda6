"""Operator 10: removal of long repeated byte strings.

The method asked for, merging shard Burrows-Wheeler transforms by interleave refinement, is in bwt_merge.py. It
needs one refinement of all suffixes for each byte of match length; README states what that costs. This module gives the
same result, from sampled suffixes.

Every window of ``length`` bytes picks its smallest hashed 200-gram (the leftmost of equals); consecutive windows
with the same pick form a region. Equal windows have equal picks, so windows only need comparing within a group of
regions with equal picks. Regions with equal contents are a class: all windows of a class of two or more are
repeated. Only where a group has several classes are single windows compared, by their hashes: all windows of
the classes of one region, against those and one region of each larger class. All counting is done by
aggregations with partial sums, so no group of copies meets in one task.

Hashes of windows are 64 bits and are compared within the group of a 64-bit pick.

Defined results: a null text is empty; documents shorter than ``length`` lose nothing; strings are judged on the
input; equal rows repeat each other; an empty table gives an empty result; other columns are carried only by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, binaries, mix64, prefix_hash, span_hash, table

LENGTH = 400
#: Bytes of a text handled at once; regions end there, windows do not.
PIECE = 1 << 20


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, windows, hash of the pick, hash of the content) of each region of a text."""
    out = []
    gram = length // 2
    for base in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text[base : base + PIECE + length - 1], np.uint8)
        prefix = prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        hashes = span_hash(prefix, at, at + gram)
        order = hashes >> np.uint64(21) << np.uint64(21) | at.astype(np.uint64)  # places break ties; a piece has under 2^21
        pick = (_sliding_min(order, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(pick, prepend=-1))
        after = np.append(first[1:], len(pick))
        out.append((base + first, after - first, hashes[pick[first]], span_hash(prefix, first, after - 1 + length)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """Hashes of the windows [first, first + n) of each span, second hash function."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for first, n in spans:
        prefix = prefix_hash(data[first : first + n - 1 + length] ^ np.uint8(0x5A))
        at = np.arange(n)
        out.append(span_hash(prefix, at, at + length))
    return out


def _with_uid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.col("text").cast("binary").alias("__text"))


def all_regions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, uid, lo, n, pick, content) of all texts. uid tells rows of equal doc_id and different text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [regions(t, length) for t in binaries(batch.column("__text"))]
            counts = [len(f[0]) for f in found]
            owner = pa.array(np.repeat(np.arange(len(found)), counts))
            lo, n, pick, content = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("uid").take(owner), pa.array(lo, pa.int64()), pa.array(n.astype(np.int32)), pa.array(pick.view(np.int64)), pa.array(content.view(np.int64))],
                names=["doc_id", "uid", "lo", "n", "pick", "content"],
            )

    given = _with_uid(docs)
    schema = given.select("doc_id", "uid").schema.add("lo", "long").add("n", "integer").add("pick", "long").add("content", "long")
    return given.mapInArrow(run, schema)


def _windows(docs: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """(key, place): a row per window of the regions in need; place is -1 for regions that only bear witness."""
    lists = need.groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(F.collect_list(F.struct("lo", "n", "pick", "id", "open")).alias("__spans"))  # of one document
    given = _with_uid(docs)
    joined = given.join(lists, given["doc_id"].eqNullSafe(lists["d"]) & (given["uid"] == lists["u"])).select("__text", "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, held = [], [], 0
            for text, spans in zip(binaries(batch.column("__text")), batch.column("__spans").to_pylist(), strict=True):
                for s, h in zip(spans, window_hashes(text, [(s["lo"], s["n"]) for s in spans], length), strict=True):
                    keys.append(mix64(h + np.uint64(s["pick"] * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64))
                    places.append(s["id"] * 256 + np.arange(s["n"]) if s["open"] else np.full(s["n"], -1))
                    held += s["n"]
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["key", "place"])
                    keys, places, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["key", "place"])

    return joined.mapInArrow(run, "key long, place long")


def repeated_spans(ws: Workspace, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, uid, start, end): byte spans that are made of repeated windows, not yet united."""
    every = ws.stage(all_regions(docs, length))
    classes = ws.stage(every.groupBy("pick", "content", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")))
    groups = classes.groupBy("pick").agg(F.count("*").alias("classes"), F.sum("copies").alias("total")).where("total > 1").select("pick", "classes")
    classes = ws.stage(classes.join(groups, "pick"))
    seen = ws.stage(every.join(classes, ["pick", "content", "n"]))
    whole = seen.where("copies > 1").select("doc_id", "uid", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    need = seen.where((F.col("classes") > 1) & ((F.col("copies") == 1) | F.col("doc_id").eqNullSafe(F.col("first"))))
    need = ws.stage(need.select("doc_id", "uid", "lo", "n", "pick", (F.col("copies") == 1).alias("open"), F.monotonically_increasing_id().alias("id")))
    windows = ws.stage(_windows(docs, need, length))
    twice = ws.stage(windows.groupBy("key").agg(F.count("*").alias("c"), F.max("place").alias("p")).where("c > 1 and p >= 0").select("key"))
    places = windows.where("place >= 0").join(twice, "key", "left_semi").select(F.shiftright("place", 8).alias("id"), F.col("place").bitwiseAND(255).alias("i"))
    starts = places.groupBy("id").agg(F.sort_array(F.collect_list("i")).alias("at"))  # at most 201
    single = need.join(starts, "id").select("doc_id", "uid", F.explode(_runs("at")).alias("r"), "lo")
    single = single.select("doc_id", "uid", (F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.b") + length).alias("end"))
    return ws.stage(whole.unionByName(single))


def _runs(column: str):
    """Runs of consecutive numbers in a sorted array, as structs (a, b) of first and last."""
    start = F.filter(F.col(column), lambda x, i: (i == 0) | (F.element_at(F.col(column), F.greatest(i, F.lit(1))) != x - 1))
    stop = F.filter(F.col(column), lambda x, i: (i == F.size(column) - 1) | (F.coalesce(F.try_element_at(F.col(column), i + 2), F.lit(-1)) != x + 1))
    return F.zip_with(start, stop, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that neither overlap nor touch, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left outside united spans."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    lists = spans.groupBy(F.col("doc_id").alias("__d"), F.col("uid").alias("__u")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))  # of one document
    uid = F.xxhash64("doc_id", "text")
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("__d")) & (uid == F.col("__u")), "left").drop("__d", "__u")


def repeats_report(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = united([(s["start"], s["end"]) for s in spans or ()])
                left = without(data, spans)
                rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield table(batch, ("text", "__spans"), **{n: pa.array(c, t) for n, c, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    with Workspace(spark, "repeats") as ws:
        given = _with_spans(docs.select("doc_id", "text"), repeated_spans(ws, docs, length))
        schema = docs.select("doc_id").schema
        for n in ("n_bytes", "n_removed", "n_spans"):
            schema = schema.add(n, "long")
        return ws.keep(given.mapInArrow(run, schema.add("kept_sha256", "string")))


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated strings, all other columns as they were (n_chars brought up to date).

    A removal that would cut a character keeps that character's bytes together by removing it whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, out = batch.schema.get_field_index("text"), []
            for text, spans in zip(batch.column(i).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                left = without(text.encode(), united([(s["start"], s["end"]) for s in spans])) if spans else None
                out.append(text if left is None else left.decode("utf-8", "ignore"))
            yield table(batch.set_column(i, "text", pa.array(out, batch.schema.field(i).type)), ("__spans",))

    with Workspace(spark, "repeats") as ws:
        out = ws.keep(_with_spans(docs, repeated_spans(ws, docs, length)).mapInArrow(run, docs.schema))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
