"""Operator 2: a quality classifier of histogram gradient-boosted trees over document statistics.

One pass over whole texts makes a vector of statistics for each document. Trees are grown on the driver from a
bounded sample of labelled rows (``sample_rows``): features are cut into at most 64 bins, each level sums gradients
and second derivatives by (node, feature, bin). The trees are complete, so they are held as three arrays (feature
and threshold by inner node, value by leaf) and scored for all rows of a batch at once with numpy.

Defined results: null and empty texts have all statistics 0 and get a score like any other; labels that are null
are left out, repeated ones are averaged (a half counts as 1); without labels every score is 0.5, with one class
it is that class's smoothed share; equal texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, binaries, table

#: The most labelled rows that are brought to the driver, chosen by a hash of doc_id (5 MB).
SAMPLE_ROWS = 40_000
N_TREES, DEPTH, RATE, N_BINS, L2, MIN_ROWS = 80, 4, 0.15, 64, 1.0, 8
_CLASSES = [b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"!", b"?", b".", b",", b":;", b"@", b"=_", b"/\\", b"{}[]()", b"\"'", b"\n"]
_TABLE = np.zeros((256, len(_CLASSES) + 5), np.float64)
for _i, _set in enumerate(_CLASSES):
    _TABLE[list(_set), _i] = 1
_TABLE[65:91, -5] = _TABLE[97:123, -4] = _TABLE[48:58, -3] = _TABLE[128:, -2] = _TABLE[[9, 10, 11, 12, 13, 32], -1] = 1
N_FEATURES = _TABLE.shape[1] + 11


def features(text: bytes) -> np.ndarray:
    """The statistics of one text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / len(text)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = set(zip(words, words[1:], strict=False))
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    rest = (
        np.log1p(len(words)), sizes.mean(), sizes.std(), sizes.max(), len(set(words)) / n, len(pairs) / n,
        len(set(lines)) / max(1, len(lines)), len(lines) / n, ends / max(1, len(lines)), (sizes <= 3).mean(), (sizes >= 12).mean(),
    )
    out[: len(shares)], out[len(shares) :] = shares, rest
    return out


def _add_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).tobytes() for t in binaries(batch.column("__text"))]
        yield table(batch, ("__text",), features=pa.array(x, pa.binary()))


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (float32 as bytes)."""
    given = docs.select("doc_id", F.col("text").cast("binary").alias("__text"))
    return given.mapInArrow(_add_features, docs.select("doc_id").schema.add("features", "binary"))


@dataclass
class Trees:
    """Complete trees in arrays: feature and threshold [tree, inner node], value [tree, leaf], and a start value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x; all rows and trees go down a level at a time."""
        raw = np.full(len(x), self.start)
        if len(self.feature) and len(x):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int32)
            for _ in range(int(np.log2(self.value.shape[1]))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            raw += self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting; deterministic for a given order of rows."""
    inner, leaves, nf = 2**DEPTH - 1, 2**DEPTH, x.shape[1]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, N_BINS + 1)[1:-1], method="lower")) for f in range(nf)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(nf) * N_BINS
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw, model = np.full(len(y), start), []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (nf * N_BINS) + flat).ravel()
            g, h, c = (np.bincount(key, w, width * nf * N_BINS).reshape(width, nf, N_BINS).cumsum(axis=2) for w in (np.repeat(grad, nf), np.repeat(curve, nf), None))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(c < MIN_ROWS) | (ct - c < MIN_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = np.full(width, N_BINS)
            for i, b in enumerate(best):
                if gain[i].ravel()[b] > 1e-6:
                    f, split[i] = divmod(int(b), N_BINS)
                    feature[first + i], threshold[first + i] = f, cuts[f][min(split[i], len(cuts[f]) - 1)]
            at = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[at])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, curve, leaves) + L2)
        raw += value[leaf]
        model.append((feature, threshold, value))
    return Trees(*(np.stack(a) for a in zip(*model, strict=True)), start)


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits trees to (doc_id, features, label) rows, to about ``sample_rows`` of them where there are more."""
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    got = sorted((r["doc_id"], bytes(r["features"]), r["label"]) for r in rows.select("doc_id", "features", "label").collect())
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(-1, N_FEATURES)
    return fit(x, np.array([r[2] for r in got], np.float64))


def held_out():
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of held-out documents are never read into the fit."""
    with Workspace(spark, "classifier") as ws:
        made = ws.stage(document_features(docs))
        known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        rows = made.where(~held_out()).join(known, "doc_id").select("doc_id", "features", "label")
        model = spark.sparkContext.broadcast(train(rows, sample_rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(binaries(batch.column("features"))), np.float32).reshape(-1, N_FEATURES)
                score = np.concatenate([model.value.score(x[i : i + 4096]) for i in range(0, len(x), 4096)] or [np.zeros(0)])
                yield table(batch, ("features",), score=score, predicted=pa.array((score >= 0.5).astype(np.int32)))

        given = made.withColumn("held_out", held_out()).select("doc_id", "held_out", "features")
        return ws.keep(given.mapInArrow(run, given.drop("features").schema.add("score", "double").add("predicted", "integer")))
