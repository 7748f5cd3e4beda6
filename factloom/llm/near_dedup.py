"""Operator 4: near-duplicates by bottom-k sketches from one hash function.

Each document's set of word shingles is hashed by one function; its sketch is the ``k`` smallest values. Equal sets
collapse to a class first, so copies cost nothing later. Inverted lists of the retained values generate the overlaps.
Not every value needs a list: with the values of a sketch in one order for all, here the rarest first, two sketches
that share c values share one among the first (size - c + 1) of each. Lists that hold more than one class are few then,
as most texts have enough values of their own. A pair of a list is estimated from its union sketch (the k smallest of
both), which drops pairs that are five standard deviations below the threshold, and verified on the full sets.

No list is expanded into all its pairs. First the classes of each list are compared with one of them, its hub: the class
whose values are the most frequent, in a group of near copies the text that the others stem from. Rows of one component
need not be compared again. What is left of lists of at most HOT rows is paired. The classes of larger ones are compared on
their full sets, by the same prefixes, now without chance: two sets that share their first common member at the
places i and j have at most min(n - i, m - j) members in common, and a link needs 4 / 9 (n + m). In a group of near copies the
rarest members are each text's own changes, so that bound leaves out most of what is not similar before it is paired, and
what is similar to a hub is in its component already. Classes that were compared with the same hub are a family; two of them are
paired only if they differ from the hub in the same way (see _family_pairs), so a group whose texts are all nearly similar
stays small, however large it is. No bound leaves out a link.

A link is missed by chance only where a sketch does not hold its whole set: about once in a million at similarity 0.8, less
above. Components come from rounds of large-star and small-star steps on the verified links.

Defined results: a text without words, empty or null, has an empty set, is linked with nothing and is its own
component; fewer words than a shingle count as one shingle; equal rows are linked; rows that share a doc_id but not
a text are separate documents; a null doc_id is never the smallest unless all are null (and then kept); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binaries, mix64, prefix_hash, span_hash, table

SKETCH = 64
THRESHOLD_PERCENT = 80
#: Five standard deviations of the union sketch's estimate at the threshold.
MARGIN = 0.25
#: Rows of a list that is paired directly; larger lists are compared on full sets.
HOT = 50
#: How often the large lists of full sets are compared with a hub before they are paired.
HUB_ROUNDS = 2
#: 64-bit words of the parities of a set's differences from a hub.
PARITY_WORDS = 16
#: Buckets in which members of sets are counted, and the parts in which the counts are summed.
BUCKETS = 1 << 18
SLICES = 64
#: Pairs (16 bytes each) that may be broadcast to what is known of their classes, or gathered to find their components; more are joined
#: by shuffles of the classes, and their components take rounds of steps on tables.
FEW_PAIRS = 100_000
#: Classes whose texts may be picked out by a broadcast of their ids (20 MB); more are joined by a shuffle of the texts.
PICK_ROWS = 200_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's distinct word shingles, ascending."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(solid))
    if not len(edges):
        return np.zeros(0, np.uint64)
    words = span_hash(prefix_hash(data), edges[::2], edges[1::2])
    n = min(width, len(words))
    acc = words[: len(words) - n + 1] ^ np.uint64(n)
    for j in range(1, n):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - n + 1 + j])
    return np.unique(mix64(acc))


def sketch_documents(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, digest of the set (16 bytes), sketch (k unsigned 64-bit values as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, width) for t in binaries(batch.column("__text")))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:k].tobytes()) for s in sets]
            n, digest, sketch = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])

    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("digest", "binary").add("sketch", "binary")
    return docs.select("doc_id", F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


def _retained(classes: DataFrame) -> DataFrame:
    """(key, node, n): the inverted lists of all retained values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = batch.column("sketch").to_pylist()
            if sketches:
                at = pa.array(np.repeat(np.arange(len(sketches)), [len(s) // 8 for s in sketches]))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sketches), np.int64)), batch.column("node").take(at), batch.column("n").take(at)], names=["key", "node", "n"])

    return classes.select("node", "n", "sketch").mapInArrow(run, "key long, node long, n long")


def _lists(ws: Workspace, classes: DataFrame, k: int) -> DataFrame:
    """(key, node, n, at, weight): the rows of the lists that a pair which passes the estimate shares one of.

    Such a pair shares at least min(0.8 n, 0.55 k) values of its sketches. ``at`` is a value's place in the sketch, rarest first;
    values of one class only come before all others and need no row. weight sums up how often a class's values occur.
    """
    every = _retained(classes)
    several = ws.stage(every.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    own = Window.partitionBy("node")
    held = F.least("n", F.lit(k))
    least = F.least(F.ceil(F.col("n") * THRESHOLD_PERCENT / 100), F.lit(-(-int(THRESHOLD_PERCENT - 100 * MARGIN) * k // 100)))
    placed = every.join(several, "key").withColumns({"at": held - F.count("*").over(own) + F.row_number().over(own.orderBy("rows", "key")) - 1, "weight": F.sum("rows").over(own)})
    return ws.stage(placed.where(F.col("at") <= held - least).select("key", "node", "n", "at", "weight"))


def _similar_size(a: str = "n", b: str = "m") -> Column:
    return (F.col(a) * 100 >= F.col(b) * THRESHOLD_PERCENT) & (F.col(b) * 100 >= F.col(a) * THRESHOLD_PERCENT)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The share of the union's k smallest values that both sketches hold."""
    union = np.union1d(a, b)[:k]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD_PERCENT * (len(a) + len(b) - both)


def _both(pairs: DataFrame, count: int, known: DataFrame, names: dict[str, str]) -> DataFrame:
    """pairs (x, y) with columns of known (node and names), once as name + x and once as name + y."""
    one, two = (known.select(F.col("node").alias(n), *[F.col(c).alias(f"{s}{n}") for c, s in names.items()]) for n in "xy")
    if count > FEW_PAIRS:
        return pairs.join(one, "x").join(two, "y")
    return one.join(F.broadcast(pairs), "x").join(two.join(F.broadcast(pairs), "y"), ["x", "y"])


def _judge(pairs: DataFrame, count: int, classes: DataFrame, k: int) -> DataFrame:
    """(x, y, sure): pairs whose estimate passes; sure where the sketches are the whole sets and prove the link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("nx", "ny", "sx", "sy")), strict=True)
            for i, (nx, ny, sx, sy) in enumerate(rows):
                a, b = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                if nx <= k and ny <= k:
                    if linked(a, b):
                        keep.append(i)
                        sure.append(True)
                elif union_estimate(a, b, k) >= THRESHOLD_PERCENT / 100 - MARGIN:
                    keep.append(i)
                    sure.append(False)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(at), batch.column("y").take(at), pa.array(sure, pa.bool_())], names=["x", "y", "sure"])

    return _both(pairs, count, classes, {"n": "n", "sketch": "s"}).mapInArrow(run, "x long, y long, sure boolean")


class _Sets:
    """Full sets of the classes that need them, read from the texts once per class."""

    def __init__(self, ws: Workspace, docs: DataFrame, classes: DataFrame, width: int):
        self.ws, self.docs, self.classes, self.width = ws, docs, classes, width
        self.known = classes.where(F.octet_length("sketch") == 8 * F.col("n")).select("node", F.col("sketch").alias("shingles"))  # whole sets already

    def of(self, nodes: DataFrame, rows: int | None = None) -> DataFrame:
        """(node, shingles) of nodes (node, about rows of them) and of others that were read before; a row per class."""
        nodes = nodes.join(self.known.select("node"), "node", "left_anti")
        nodes = self.ws.stage(nodes.join(self.classes.select("node", "doc", "digest"), "node"), rows)
        if count := nodes.count():
            wanted = F.broadcast(nodes) if count <= PICK_ROWS else nodes
            texts = self.docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("__text"))
            width = self.width

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    node, sets = [], []
                    for i, d, t in zip(*(batch.column(c).to_pylist() for c in ("node", "digest", "__text")), strict=True):
                        raw = shingles(t or b"", width).tobytes()
                        if xxhash.xxh3_128_digest(raw) == d:  # else another text of the same doc_id
                            node.append(i)
                            sets.append(raw)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

            found = texts.join(wanted, texts["doc"].eqNullSafe(wanted["doc"])).select("node", "digest", "__text").mapInArrow(run, "node long, shingles binary")
            found = self.ws.stage(found)
            if found.count() > count:  # the doc_id and its text are repeated
                found = self.ws.stage(found.dropDuplicates(["node"]))
            self.known = self.known.unionByName(found)
        return self.known


def _verify(ws: Workspace, judged: DataFrame, sets: _Sets, read: bool = True) -> DataFrame:
    """(x, y) of the pairs that are links on their full sets; these are known already unless ``read``."""
    open_ = judged.where("not sure").select("x", "y")
    if not (count := open_.count()):
        return judged.select("x", "y")
    known = sets.of(open_.select(F.explode(F.array("x", "y")).alias("node")).distinct(), count) if read else sets.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sx", "sy")), strict=True)
            ok = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    checked = ws.stage(_both(open_, count, known, {"shingles": "s"}).mapInArrow(run, "x long, y long"), count)
    return judged.where("sure").select("x", "y").unionByName(checked)


def _joined(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """(nodes, the smallest node of the component of each) of all nodes with an edge but those that are the smallest themselves."""
    up: dict[int, int] = {}

    def top(n: int) -> int:
        while (above := up.get(n, n)) != n:
            up[n] = n = up.get(above, above)
        return n

    for a, b in zip(x, y, strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return list(up), [top(n) for n in up]


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge (x, y) but each component's smallest; comp is the smallest node of the component. Few links are
    gathered, as every step on tables costs some tasks whatever their size."""
    if edges.count() <= FEW_PAIRS:
        found = edges.select(F.col("x").cast("long"), F.col("y").cast("long")).toArrow()
        nodes, least = _joined(*(found.column(c).to_pylist() for c in ("x", "y")))
        made = pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array(least, pa.int64())})
        return ws.stage(ws.spark.createDataFrame(made).coalesce(1))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    edges, before = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("least", "x").alias("low"))
        large = ws.stage(both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct())
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x").where("y <> low").select(F.greatest("y", "low").alias("x"), F.least("y", "low").alias("y"))
        edges = ws.stage(small.unionByName(low.select("x", F.col("low").alias("y"))).where("x <> y").distinct())
        after = mark(edges)
        if after == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
        before = after


def _grown(ws: Workspace, comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after more links; only the components that they join are worked on."""
    if links.isEmpty():
        return comps
    if comps is None:
        return components(ws, links)
    every = comps.select(F.col("node").alias("x"), F.col("comp").alias("y")).unionByName(links)
    if every.count() <= FEW_PAIRS:
        return components(ws, every)
    for c in "xy":
        label = comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        links = links.join(label, c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))
    joined = ws.stage(links.where("x_comp <> y_comp").select(F.col("x_comp").alias("x"), F.col("y_comp").alias("y")).distinct())
    if joined.isEmpty():
        return comps
    moved = components(ws, joined)  # of the components' smallest nodes
    moves = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return ws.stage(comps.join(moves, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).unionByName(moved))


def _open(ws: Workspace, rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows of lists that still hold more than one component, with comp and the number of the list's rows."""
    rows, count = rows.drop("comp", "rows"), rows.count()
    if comps is None:
        rows = rows.withColumn("comp", F.col("node"))
    else:
        rows = ws.stage(rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), count)
    several = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("rows")).where("a <> b").select("key", "rows")
    return ws.stage(rows.join(several, "key"), count)


def _ordered(found: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The distinct pairs (x, y), x < y, of pairs (a, b) that were not compared before."""
    pairs = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti")


def _hub_pairs(ws: Workspace, rows: DataFrame, hubs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of each list's rows with the list's hub, (key, node, hub, weight) of all rows and hubs so far). A list's next hub is
    of a component that none of its hubs is of."""
    free = rows
    if hubs is not None:
        used = rows.join(hubs.where("node = hub").select("key", "node"), ["key", "node"]).select("key", "comp").distinct()
        free = rows.join(used, ["key", "comp"], "left_anti")
    best = free.groupBy("key").agg(F.max(F.struct("weight", "node", "comp", "n")).alias("h"))
    rows = ws.stage(rows.drop("weight").join(best, "key").select("key", "node", "comp", "n", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp"), F.col("h.n").alias("m"), F.col("h.weight").alias("weight")), rows.count())
    pairs = rows.where((F.col("comp") != F.col("hub_comp")) & _similar_size()).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    mine = rows.select("key", "node", "hub", "weight")
    return pairs, mine if hubs is None else hubs.unionByName(mine)


def _list_pairs(rows: DataFrame, whole: Column) -> DataFrame:
    """(a, b): classes of a list, of similar size, but different components.

    Where the sets of both are whole a pair is left out if what follows its places cannot hold as many common members as a link has. That
    holds for the first value that the two share, and one value is enough.
    """
    rows = rows.select("key", "node", "comp", "n", "at", whole.alias("whole"))
    right = rows.select("key", F.col("node").alias("b"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("at").alias("r_at"), F.col("whole").alias("r_whole"))
    return rows.join(right, "key").where((F.col("node") < F.col("b")) & (F.col("comp") != F.col("c")) & _similar_size() & (~F.col("whole") | ~F.col("r_whole") | _fits())).select(F.col("node").alias("a"), "b")


def _fits() -> Column:
    """Whether sets of n and m members that share their first common one at the places at and r_at can be linked: 9 |x & y| >= 4 (n + m)."""
    least = 4 * (F.col("n") + F.col("m"))
    return (9 * (F.col("n") - F.col("at")) >= least) & (9 * (F.col("m") - F.col("r_at")) >= least)


def _bucket(values: np.ndarray) -> np.ndarray:
    return (mix64(values) % np.uint64(BUCKETS)).astype(np.int64)


def _rarity(given: DataFrame) -> np.ndarray:
    """How many of the members (binary) fall in each of BUCKETS buckets. Tasks count densely and are summed slice by slice, so what the
    driver gets is as long for every input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(np.frombuffer(b"".join(batch.column("members").to_pylist()), np.uint64)), minlength=BUCKETS)
        if total.any():
            slices = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return table.slice(0, 1).set_column(1, "counts", pa.array([total.tobytes()], pa.binary()))

    schema = "slice int, counts binary"
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for row in given.select("members").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect():  # SLICES rows
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def _rare(ws: Workspace, given: DataFrame) -> DataFrame:
    """(key, node, at, weight): the rarest ``take`` members of each row (node, take, members) and their places in it.

    Any order that holds for all rows serves; this one is by the members in a member's bucket, then by the member. Members alone in their
    bucket come first and need no row.
    """
    often = _rarity(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, counts, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for raw, take in zip(batch.column("members").to_pylist(), batch.column("take").to_pylist(), strict=True):
                values = np.frombuffer(raw, np.uint64)
                of = often[_bucket(values)]
                first = np.lexsort((values, of))[:take]
                shared = np.flatnonzero(of[first] > 1)
                keys.append(values[first[shared]])
                places.append(shared)
                counts.append(len(shared))
                weights.append(int(of.sum()))
            at = np.repeat(np.arange(len(counts)), counts)
            cols = [np.concatenate(keys).view(np.int64), batch.column("node").to_numpy()[at], np.concatenate(places), np.array(weights, np.int64)[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "node", "at", "weight"])

    return ws.stage(given.select("node", "take", "members").mapInArrow(run, "key long, node long, at long, weight long"))


def _whole_lists(ws: Workspace, nodes: DataFrame, sets: _Sets) -> DataFrame:
    """(key, node, n, at, weight) of the rarest members of full sets, as many as any link shares one of."""
    nodes = nodes.join(sets.classes.select("node", "n"), "node")
    take = F.col("n") - F.ceil(F.col("n") * THRESHOLD_PERCENT / 100) + 1
    count = nodes.count()
    given = ws.stage(sets.of(nodes.select("node"), count).withColumnRenamed("shingles", "members").join(nodes.withColumn("take", take), "node"), count)
    return _rare(ws, given.select("node", "take", "members")).join(given.select("node", "n"), "node")


def differences(of: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """Hashes of a set's differences from a hub: members that the hub lacks, and the hub's that it lacks."""
    more, less = np.setdiff1d(of, hub, assume_unique=True), np.setdiff1d(hub, of, assume_unique=True)
    return np.sort(np.concatenate([mix64(more), mix64(less ^ np.uint64(0xA5A5A5A5A5A5A5A5))]))


def parities(values: np.ndarray) -> np.ndarray:
    """PARITY_WORDS words of 64 bits, each bit the parity of the count of values that fall on it.

    The parities of two sets differ in no more bits than the sets in members.
    """
    odd = np.bincount((values % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _family_pairs(ws: Workspace, family: DataFrame, comps: DataFrame | None, sets: _Sets) -> DataFrame:
    """(a, b): classes of a family (node, hub), but different components, that differ from its hub in the same way. All sets are known.

    A link has 9 |x ^ y| <= n + m, and x ^ y is Dx ^ Dy, where Dx and Dy are the differences from the hub. If these have nothing in common
    then |Dx| + |Dy| <= (n + m) / 9, so both x and y are linked with the hub, and of one component. So a link shares a difference.
    Before the first that it shares, at the places i and j of an order that holds for all, stand at least i + j members of Dx ^ Dy,
    and what follows holds at most min(|Dx| - i, |Dy| - j) shared ones; so i <= n / 4, and in the smaller of Dx and Dy j <= m / 8.
    Pairs whose parities differ in more bits than a link may in members are left out too.
    """
    members, known = _open_families(ws, family, comps), sets.known
    count = members.count()
    own = known.select("node", F.col("shingles").alias("mine"))
    central = known.select(F.col("node").alias("hub"), F.col("shingles").alias("central"))

    def diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, signs, n, d = [], [], [], []
            for a, b, h in zip(*(batch.column(c).to_pylist() for c in ("mine", "central", "hub")), strict=True):
                values = mix64(differences(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) + np.uint64(h))
                found.append(values.tobytes())
                signs.append(parities(values))
                n.append(len(a) // 8)
                d.append(len(values))
            cols = [pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), *cols], names=["node", "comp", "n", "d", "signs", "members"])

    made = ws.stage(members.join(own, "node").join(central, "hub").mapInArrow(diffs, "node long, comp long, n long, d long, signs array<bigint>, members binary"), count)
    rows = _rare(ws, made.withColumn("take", (F.floor(F.col("n") / 4) + 1).cast("long"))).drop("weight").join(made.drop("members"), "node")
    rows = _shared(ws, rows)
    right = rows.where(8 * F.col("at") <= F.col("n")).select("key", F.col("node").alias("b"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("d").alias("r_d"), F.col("at").alias("r_at"), F.col("signs").alias("r_signs"))
    larger = (F.col("d") > F.col("r_d")) | ((F.col("d") == F.col("r_d")) & (F.col("node") < F.col("b")))
    apart = F.col("d") + F.col("r_d") - 2 * F.least(F.col("d") - F.col("at"), F.col("r_d") - F.col("r_at"))
    unlike = sum((F.bit_count(F.col("signs")[i].bitwiseXOR(F.col("r_signs")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    near = (9 * apart <= F.col("n") + F.col("m")) & (9 * unlike <= F.col("n") + F.col("m"))
    return rows.join(right, "key").where(larger & (F.col("comp") != F.col("c")) & _similar_size() & near).select(F.col("node").alias("a"), "b")


def _open_families(ws: Workspace, family: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(node, hub, comp) of families that hold more than one component."""
    if comps is None:
        members = family.withColumn("comp", F.col("node"))
    else:
        members = family.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = members.groupBy("hub").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("hub")
    return ws.stage(members.join(several, "hub"), family.count())


def _shared(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one component."""
    several = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    return ws.stage(rows.join(several, "key"), rows.count())


def _foreign_pairs(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(a, b): classes of a list of full sets, but different components and families (hub).

    The rows of a list's largest family are joined with the list's other rows only, never with each other.
    """
    listed = rows.count()
    filled = rows.where("hub is not null").groupBy("key", "hub").agg(F.count("*").alias("fill"))
    main = filled.groupBy("key").agg(F.max(F.struct("fill", "hub")).alias("f")).select("key", F.col("f.hub").alias("main_hub"))
    rows = rows.join(main, "key", "left").withColumn("main", F.coalesce(F.col("hub") == F.col("main_hub"), F.lit(False)))
    rows = ws.stage(rows.select("key", "node", "comp", "n", "at", "hub", "main"), listed)
    right = rows.select("key", F.col("node").alias("b"), F.col("comp").alias("c"), F.col("n").alias("m"), F.col("at").alias("r_at"), F.col("hub").alias("h"), F.col("main").alias("r_main"))
    apart = (F.col("r_main") | (F.col("node") < F.col("b"))) & (F.col("comp") != F.col("c")) & ~F.coalesce(F.col("hub") == F.col("h"), F.lit(False))
    return rows.where("not main").join(right, "key").where(apart & _similar_size() & _fits()).select(F.col("node").alias("a"), "b")


def near_links(ws: Workspace, docs: DataFrame, classes: DataFrame, width: int, k: int = SKETCH) -> DataFrame | None:
    """(node, comp) of the classes that are linked with another; None if there are none."""
    sets, comps, tried = _Sets(ws, docs, classes, width), None, None

    def compare(found: DataFrame, of: DataFrame, estimate: bool) -> None:
        nonlocal comps, tried
        pairs = ws.stage(_ordered(found, tried), of.count())
        if not (count := pairs.count()):
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        judged = ws.stage(_judge(pairs, count, classes, k), count) if estimate else pairs.withColumn("sure", F.lit(False))
        comps = _grown(ws, comps, _verify(ws, judged, sets, read=estimate))

    rows = _open(ws, _lists(ws, classes, k), None)
    if rows.isEmpty():
        return None
    compare(_hub_pairs(ws, rows, None)[0], rows, estimate=True)
    rows = _open(ws, rows, comps)
    compare(_list_pairs(rows.where(F.col("rows") <= HOT), F.col("n") <= k), rows, estimate=True)
    hot = _open(ws, rows.where(F.col("rows") > HOT), comps)
    if hot.isEmpty():
        return comps
    rows, hubs = _whole_lists(ws, ws.stage(hot.select("node").distinct()), sets), None
    for _ in range(HUB_ROUNDS):
        rows = _open(ws, rows, comps)
        if (large := rows.where(F.col("rows") > HOT)).isEmpty():
            break
        found, hubs = _hub_pairs(ws, large, hubs)
        compare(found, rows, estimate=False)
    if hubs is None:
        family = ws.spark.createDataFrame([], "node long, hub long")
    else:
        family = _families(ws, hubs)
        compare(family.select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b"), family, estimate=False)
        compare(_family_pairs(ws, family, comps, sets), rows, estimate=False)
    rows = _open(ws, rows, comps)
    if not rows.isEmpty():
        compare(_foreign_pairs(ws, rows.join(family, "node", "left")), rows, estimate=False)
    return comps


def _families(ws: Workspace, hubs: DataFrame) -> DataFrame:
    """(node, hub): of the hubs of each class the heaviest, or that hub's own, twice; so that a group of many hubs is one family."""
    family = ws.stage(hubs.groupBy("node").agg(F.max(F.struct("weight", "hub")).alias("h")).select("node", F.col("h.hub").alias("hub")), hubs.count())
    for _ in range(2):
        up = family.select(F.col("node").alias("hub"), F.col("hub").alias("up"))
        family = ws.stage(family.join(up, "hub", "left").select("node", F.coalesce("up", "hub").alias("hub")), family.count())
    return family


def _named(ws: Workspace, docs: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest of a row per document; digest, doc, comp of a row per class)."""
    made = ws.stage(sketch_documents(docs, width, k))
    full = made.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = ws.stage(classes.withColumn("node", F.monotonically_increasing_id()))
    comps = near_links(ws, docs, classes, width, k)
    named = classes.select("digest", "node", "doc")
    if comps is not None:
        named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        named = named.withColumn("comp", F.col("node"))
    return made.select("doc_id", "n_shingles", "digest"), ws.stage(named.select("digest", "doc", "comp"), classes.count())


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row per document."""
    with Workspace(spark, "near") as ws:
        made, named = _named(ws, docs, width, k)
        count = named.count()
        least = ws.stage(named.groupBy("comp").agg(F.min("doc").alias("component_id")), count)
        named = ws.stage(named.join(least, "comp").select("digest", "component_id"), count)
        out = made.join(named, "digest", "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return ws.keep(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def _digested(docs: DataFrame, width: int) -> DataFrame:
    """The documents with __digest, the digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, width) for t in binaries(batch.column("text")))
            yield table(batch, (), __digest=pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()))

    return docs.mapInArrow(run, docs.select("*").schema.add("__digest", "binary"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each component of near_duplicates, of the smallest doc_id in it, with all columns.

    A doc_id that is null or repeated does not tell which of its texts is kept; there the set's digest does too. Rows without
    words are all kept, as each is its own component.
    """
    with Workspace(spark, "near") as ws:
        made, named = _named(ws, docs, width, SKETCH)
        first = named.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "digest")).alias("f"))
        kept = first.select(F.col("f.doc").alias("doc_id"), F.col("f.digest").alias("digest"))
        kept = ws.stage(kept.unionByName(made.where("n_shingles = 0").select("doc_id", F.lit(None).cast("binary").alias("digest"))))
        repeated = ws.keep(made.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"))
        several = not repeated.isEmpty()
        single = kept.where("doc_id is not null").select("doc_id")
        if several:
            single = single.join(repeated, "doc_id", "left_anti")
            marked = Workspace(spark, "near").keep(kept.where("digest is not null").select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__digest")))
        single = Workspace(spark, "near").keep(single)
    out = docs.join(single, "doc_id", "left_semi").select(*docs.columns)
    if several:
        doubtful = _digested(docs.where("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns)), width)
        once = doubtful.where("__digest is not null").dropDuplicates(["doc_id", "__digest"]).join(marked, "__digest").where(F.col("doc_id").eqNullSafe(F.col("__kept")))
        out = out.unionByName(once.select(*docs.columns)).unionByName(doubtful.where("__digest is null").select(*docs.columns))
    return out
