"""Operator 6: mixing sources to target weights.

Every source is a stream of its documents' words in an order that only depends on the documents. The stream is cut
into blocks of ``block`` words. Slots of the mix are dealt to output shards of ``shard_slots`` slots: the source
counts of a shard are a multinomial draw with the sources' remaining slots as weights, cut off at what remains, so
that the shards together take each source's target exactly. One task deals slots to groups of SHARD_GROUP shards in this way, then each
group to its shards in a task of its own. The j-th slot of a source maps to block
perm(j div blocks, j mod blocks), a keyed Feistel permutation of its block indices per round, so a block is used at
most once more than any other. Slots and blocks are joined by (source, block index); the source's last slot takes
only the words that are still missing.

Targets: sources by code point (null last) weigh 1, 2, 3, 1, 2, 3 ...; they share all words by weight; a target
stops at 3 times its source's words, and the excess goes to the others by weight until none is above.

Defined results: a null text has size 0 and is taken 0 times; an empty source (no words) has target 0; equal rows
are separate documents; an empty table gives an empty result; reruns agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binaries, table

BLOCK = 512
SHARD_SLOTS = 4096
#: Shards that are dealt from one group; a group's draws are sequential.
SHARD_GROUP = 4096
MAX_REPEATS = 3
SEED = 20
#: Documents of a source that one window of the word order holds, about.
ORDER_ROWS = 50_000
#: The most sources a mix may have; their sizes and targets are held on the driver.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """The words to take from each source."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > MAX_REPEATS * sizes[i] * total}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in sorted(over):
            out[i] = float(MAX_REPEATS * sizes[i])
            left -= out[i]
        open_ -= over
        left = max(left, 0.0)
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a four-round Feistel network over the next power of four, walked into range."""
    if n <= 1:
        return np.zeros_like(index)
    half = np.uint64((int(n - 1).bit_length() + 1) // 2)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & low
        for r in range(4):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(29)) & low)
        out[todo] = left << half | right
        todo = out >= n
    return out.astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield table(batch, ("__text",), __size=pa.array([len(t.split()) for t in binaries(batch.column("__text"))], pa.int64()))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, __hash (of the text) and __size (its words), a row per document."""
    given = docs.select("doc_id", "source", F.xxhash64("text").alias("__hash"), F.col("text").cast("binary").alias("__text"))
    return given.mapInArrow(_count_words, given.drop("__text").schema.add("__size", "long"))


def word_order(rows: DataFrame, n_rows: int) -> DataFrame:
    """doc_id, source, __hash, __size and __start, the words of the same source before each.

    Rows of equal doc_id, source and text are laid out together as one (__copies). The order of these is by (hash bucket, doc_id, hash);
    buckets hold about ORDER_ROWS rows of the largest possible source, so neither the sums over buckets nor a bucket's window
    grows into one large task, whatever is repeated or null.
    """
    buckets = max(64, -(-n_rows // ORDER_ROWS))
    rows = rows.groupBy("doc_id", "source", "__hash", "__size").agg(F.count("*").alias("__copies"))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "__hash"), F.lit(buckets)).cast("int")).withColumn("__all", F.col("__size") * F.col("__copies"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "__bucket").agg(F.sum("__all").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sums = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__base")
    inside = Window.partitionBy("source", "__bucket").orderBy("doc_id", "__hash", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__all").over(inside), F.lit(0)))
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["__s"]) & (rows["__bucket"] == sums["__b"]))
    each = joined.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    return each.select("doc_id", "source", "__hash", "__size", "__copies", "__nth", (F.col("__base") + F.col("__in") + (F.col("__nth") - 1) * F.col("__size")).alias("__start"))


def plan(rows: DataFrame, block: int) -> list[dict]:
    """A row per source: its words, blocks, weight, target in words and slots. Sources are few; they are checked."""
    sums = rows.groupBy("source").agg(F.sum("__size").alias("size"))
    got = sums.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in got]
    goal = targets(sizes, [1 + i % 3 for i in range(len(got))])
    out = []
    for i, (r, t) in enumerate(zip(got, goal, strict=True)):
        words, blocks = round(t), -(-r["size"] // block)
        rounds, rest = divmod(words, r["size"]) if r["size"] else (0, 0)
        out.append({"id": i, "source": r["source"], "size": r["size"], "target": t, "words": words, "blocks": blocks, "rounds": rounds, "rest": rest})
    return out


def _last_round(p: dict, block: int, seed: int) -> tuple[int, int]:
    """Slots of the round that is not taken whole, and the words that the last of them takes."""
    if not p["rest"]:
        return 0, 0
    short = p["blocks"] * block - p["size"]  # what the source's last block lacks
    place = _place_of(p["blocks"] - 1, p["blocks"], key(p["id"], p["rounds"], seed)) if p["blocks"] > 1 else 0
    room = lambda n: n * block - (short if place < n else 0)
    n = -(-p["rest"] // block)
    n += room(n) < p["rest"]
    return n, p["rest"] - room(n - 1)


def _slots_of(p: dict, block: int, seed: int) -> int:
    """Slots of a source: whole rounds over its blocks, then blocks of one more round until the rest is taken."""
    return p["rounds"] * p["blocks"] + _last_round(p, block, seed)[0]


def key(source: int, round_: int, seed: int) -> int:
    return (seed * 1_000_003 + source) * 101 + round_


def _place_of(value: int, n: int, k: int) -> int:
    """The index that the permutation maps to value: the inverse walk of the same network."""
    half = (int(n - 1).bit_length() + 1) // 2
    low, m = (1 << half) - 1, 2**64 - 1
    x = value
    while True:
        left, right = x >> half, x & low
        for r in reversed(range(4)):
            kk = (k * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & m
            f = ((left ^ kk) * 0xBF58476D1CE4E5B9) & m
            f = ((f ^ (f >> 31)) * 0x94D049BB133111EB) & m
            left, right = right ^ ((f >> 29) & low), left
        x = left << half | right
        if x < n:
            return x


def deal(left: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Counts by source of one hand of ``size`` slots after the other, until none is left."""
    left = left.copy()
    while left.sum():
        want, counts = min(size, int(left.sum())), np.zeros(len(left), np.int64)
        while want:
            open_ = left - counts
            more = np.minimum(rng.multinomial(want, open_ / open_.sum()), open_)
            counts += more
            want -= int(more.sum())
        yield counts
        left -= counts


def draw(spark: SparkSession, sources: list[dict], block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source id, first, n): the slots [first, first + n) of a source that a shard takes.

    The first task handles a row per source for some 9 billion words, the tasks after it a row per source and shard.
    """
    total, names = np.array([_slots_of(p, block, seed) for p in sources], np.int64), ["shard", "id", "first", "n"]

    def hands(ids: np.ndarray, first: np.ndarray, n: np.ndarray, size: int, number: int, rng: np.random.Generator) -> Iterator[list[pa.Array]]:
        for k, counts in enumerate(deal(n, size, rng)):
            some = np.flatnonzero(counts)
            yield [pa.array(np.full(len(some), number + k)), pa.array(ids[some]), pa.array(first[some]), pa.array(counts[some])]
            first = first + counts

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        for cols in hands(np.arange(len(total)), np.zeros(len(total), np.int64), total, SHARD_GROUP * shard_slots, 0, np.random.Generator(np.random.PCG64(seed))):
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def shards(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        group, (ids, first, n) = table.column("shard")[0].as_py(), (table.column(c).to_numpy() for c in names[1:])
        parts = [pa.table(cols, names=names) for cols in hands(ids, first, n, shard_slots, group * SHARD_GROUP, np.random.Generator(np.random.PCG64([seed, group])))]
        return pa.concat_tables(parts)

    schema = "shard long, id long, first long, n long"
    return spark.range(1, numPartitions=1).mapInArrow(groups, schema).groupBy("shard").applyInArrow(shards, schema)


def slots(drawn: DataFrame, sources: list[dict], block: int, seed: int) -> DataFrame:
    """(shard, id, slot, round, block): a row per slot, with the block of the source that fills it."""
    blocks = {p["id"]: p["blocks"] for p in sources}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, j = blocks[row["id"]], np.arange(row["first"], row["first"] + row["n"])
                rounds, at = np.divmod(j, n)
                index = np.empty(len(j), np.int64)
                for r in np.unique(rounds):
                    index[rounds == r] = permute(at[rounds == r], n, key(row["id"], int(r), seed))
                k = len(j)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["shard"])), pa.array(np.full(k, row["id"])), pa.array(j), pa.array(rounds), pa.array(index)], names=["shard", "id", "slot", "round", "block"])

    return drawn.repartition("shard").mapInArrow(run, "shard long, id long, slot long, round long, block long")


def cells(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document with words touches: __block, __lo and __hi (its words in the block)."""
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__size") - 1) / block)
    out = rows.where("__size > 0").withColumn("__block", F.explode(F.sequence(first, last)))
    low = F.col("__block") * block
    return out.withColumn("__lo", F.greatest("__start", low) - low).withColumn("__hi", F.least(F.col("__start") + F.col("__size"), low + block) - low)


def mix(spark: SparkSession, ws: Workspace, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
    """(rows, sources, uses): documents with their place in their source's word order; the plan; and per source id and
    block how many slots take it in full (``full``), which rounds do, and how many of its words one more slot takes (``part``)."""
    rows = ws.stage(sized(docs))
    sources, n_rows = plan(rows, block), rows.count()
    rows = word_order(rows, n_rows)
    if not sources:
        return rows, sources, None
    ids = spark.createDataFrame([(p["source"], p["id"]) for p in sources], "__source string, __id long")
    if len(sources) <= 20_000:
        ids = F.broadcast(ids)
    rows = ws.stage(rows.join(ids, rows["source"].eqNullSafe(ids["__source"])).drop("__source"))
    used = slots(draw(spark, sources, block, shard_slots, seed), sources, block, seed)
    ends = [(p["id"], _slots_of(p, block, seed) - 1, _last_round(p, block, seed)[1]) for p in sources if p["rest"]]
    cut = spark.createDataFrame(ends, "id long, slot long, words long")
    if len(sources) <= 20_000:
        cut = F.broadcast(cut)
    used = used.join(cut, ["id", "slot"], "left")
    uses = used.groupBy("id", "block").agg(F.sort_array(F.collect_list(F.when(F.col("words").isNull(), F.col("round")))).alias("full"), F.max("words").alias("part"), F.max(F.when(F.col("words").isNotNull(), F.col("round"))).alias("part_round"))
    return rows, sources, uses


def _joined(rows: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    each = cells(rows, block)
    return each.join(uses, (each["__id"] == uses["id"]) & (each["__block"] == uses["block"])).drop("id", "block")


def _part_words() -> Column:
    return F.greatest(F.lit(0), F.least(F.col("__hi"), F.coalesce("part", F.lit(0))) - F.col("__lo"))


def mix_report(spark: SparkSession, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    with Workspace(spark, "mix") as ws:
        rows, sources, uses = mix(spark, ws, docs, block, shard_slots, seed)
        if not sources:
            return spark.createDataFrame([], docs.select("doc_id").schema.add("size", "long").add("source_size", "long").add("target", "double").add("taken", "long"))
        taken = _joined(rows, uses, block).groupBy("__id", "__start").agg(F.sum((F.col("__hi") - F.col("__lo")) * F.size("full") + _part_words()).alias("taken"))
        taken = taken.select(F.col("__id").alias("i"), F.col("__start").alias("s"), "taken")
        facts = spark.createDataFrame([(p["id"], p["size"], p["target"]) for p in sources], "f long, source_size long, target double")
        if len(sources) <= 20_000:
            facts = F.broadcast(facts)
        out = rows.join(taken, (rows["__id"] == taken["i"]) & (rows["__start"] == taken["s"]) & (rows["__size"] > 0), "left")
        out = out.join(facts, out["__id"] == facts["f"])
        return ws.keep(out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans (from, to, in words), with the white space between them as it was."""
    data = text.encode()
    solid = ~np.isin(np.frombuffer(data, np.uint8), (9, 10, 11, 12, 13, 32))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if spans == [(0, len(starts))]:
        return text
    return "\n".join(data[starts[a] : ends[b - 1]].decode() for a, b in spans)


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row per document and round that takes words of it, with those words as its text.

    A document taken in full keeps its text. One that is taken up to three times comes up to three times. Each of repeated rows
    has its own takes; which of them has which is left open. Columns are those of ``docs``.
    """
    with Workspace(spark, "mix") as ws:
        rows, sources, uses = mix(spark, ws, docs, block, shard_slots, seed)
        if not sources:
            return docs
        each = _joined(rows, uses, block)
        at = F.col("__block") * block - F.col("__start")
        whole = F.transform("full", lambda r: F.struct(r.alias("r"), (F.col("__lo") + at).alias("a"), (F.col("__hi") + at).alias("b")))
        part = F.when(_part_words() > 0, F.array(F.struct(F.col("part_round").alias("r"), (F.col("__lo") + at).alias("a"), (F.least("__hi", "part") + at).alias("b"))))
        spans = each.withColumn("x", F.explode(F.concat(whole, F.coalesce(part, F.array().cast("array<struct<r:bigint,a:bigint,b:bigint>>")))))
        takes = spans.groupBy("__id", "__start").agg(F.sort_array(F.collect_list("x")).alias("__takes"))
        named = rows.where("__size > 0").select(F.col("doc_id").alias("__d"), F.col("__hash").alias("__h"), F.col("__id").alias("__i"), F.col("__nth").alias("__n"), "__copies", "__start", "__id")
        takes = ws.keep(named.join(takes, ["__id", "__start"]).select("__d", "__h", "__i", "__n", "__takes", "__copies"))
        repeated = ws.stage(takes.where("__copies > 1").select("__d", "__h", "__i").distinct())
        several = not repeated.isEmpty()
        if several:
            repeated = Workspace(spark, "mix").keep(repeated)
    names = docs.columns
    ids = spark.createDataFrame([(p["source"], p["id"]) for p in sources], "__source string, __id long")
    texts = docs.join(F.broadcast(ids) if len(sources) <= 20_000 else ids, docs["source"].eqNullSafe(F.col("__source"))).drop("__source")
    texts = texts.withColumn("__hash", F.xxhash64("text"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["__d"]) & (a["__hash"] == b["__h"]) & (a["__id"] == b["__i"])
    single = takes.where("__copies = 1")
    joined = texts.join(single, same(texts, single)).select(*names, "__takes")
    if several:  # only these rows are numbered
        number = Window.partitionBy("doc_id", "__hash", "__id").orderBy("__hash")
        numbered = texts.join(repeated, same(texts, repeated), "left_semi").withColumn("__nth", F.row_number().over(number).cast("long"))
        more = takes.where("__copies > 1")
        joined = joined.unionByName(numbered.join(more, same(numbered, more) & (numbered["__nth"] == more["__n"])).select(*names, "__takes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, keep, texts = batch.schema.get_field_index("text"), [], []
            for k, (text, takes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__takes").to_pylist(), strict=True)):
                rounds: dict[int, list[tuple[int, int]]] = {}
                for t in takes:
                    own = rounds.setdefault(t["r"], [])
                    if own and own[-1][1] == t["a"]:
                        own[-1] = (own[-1][0], t["b"])
                    else:
                        own.append((t["a"], t["b"]))
                for r in sorted(rounds):
                    keep.append(k)
                    texts.append(_cut(text, rounds[r]))
            rows = batch.take(pa.array(keep, pa.int64())).select(names)
            yield rows.set_column(i, "text", pa.array(texts, batch.schema.field(i).type))

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
