"""Operator 1: quality rules whose cutoffs come from quantile sketches per language and source.

Every document gets a few whole-number measures. A sketch of a measure is a table of (bucket, count) with
buckets that are exact below 64 and within 1/32 above (a histogram with logarithmic buckets), so sketches merge
by adding counts, in any order, with the same result. A document fails if a measure lies above its group's fence:
q75 + SPREADS * (q75 - q50) of the group, or a share of q99 of the merged sketch of its language, whichever is larger, as
many groups have no spread at all. Groups with fewer than ``min_docs`` documents use the merged sketch of their
language in place of their own, and languages with too few the merged sketch of all.

Defined results: a null or empty text has no words and fails the base rules; null language or source is a group
of its own; equal rows each get a row; an empty table gives an empty result; other columns are carried only by
``filter_quality``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, binaries, small_join, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPS = bytes(range(65, 91))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 50
#: How many times the distance from median to upper quartile a measure may lie above the latter.
SPREADS = 6
#: One in a hundred, in the measures' units, is added to every fence, for groups and languages in which nearly all have none.
TOLERANCE = 10
#: Measure: (numerator, denominator, factor, percent of the language's q99 that is always allowed). The share is small where q99 lies in the junk.
MEASURES = {
    "m_symbols": ("n_symbols", "n_words", 1000, 10),
    "m_word_chars": ("word_chars", "n_words", 100, 80),
    "m_dup_lines": ("n_dup_lines", "n_lines", 1000, 200),
    "m_repeat": ("n_repeat_words", "n_words", 1000, 250),
    "m_caps": ("n_caps", "word_chars", 1000, 300),
    "m_bangs": ("n_bangs", "n_words", 1000, 200),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_bangs")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers of COUNTS for one text in UTF-8."""
    words = text.split()  # bytes split at the six ASCII white-space characters
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, SPACES)
    chars = len(solid.decode("utf-8", "replace"))
    return (
        len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(solid) - len(solid.translate(None, CAPS)), solid.count(b"!"),
    )


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = "__text" if "__text" in batch.schema.names else "text"
        cols = list(zip(*map(counts, binaries(batch.column(text))), strict=True)) or [()] * len(COUNTS)
        yield table(batch, ("__text",), **{f"__q_{n}": pa.array(c, pa.int64()) for n, c in zip(COUNTS, cols, strict=True)})


def document_stats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs and the counts as __q_ columns, one pass over whole texts."""
    given = docs.select(*columns) if "text" in columns else docs.select(*columns, F.col("text").cast("binary").alias("__text"))
    schema = given.drop("__text").schema
    for n in COUNTS:
        schema = schema.add(f"__q_{n}", "long")
    return given.mapInArrow(_add_counts, schema)


def bucket(v):
    """The sketch bucket of a whole number as a Column: v below 64, then 32 buckets per power of two."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long")).cast("long")


def bucket_top(b):
    """The largest value of a bucket."""
    shift = F.floor((b - 32) / 32).cast("int")
    return F.when(b < 64, b).otherwise((((b - 32) % 32 + 33) * F.pow(F.lit(2.0), shift)).cast("long") - 1).cast("long")


def _measure(num: str, den: str, factor: int):
    n, d = F.col(f"__q_{num}"), F.col(f"__q_{den}")
    return F.when(d > 0, F.floor(F.lit(factor) * n / d)).otherwise(F.lit(0)).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches of every group."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(_measure(*how[:3])).alias("bucket")) for m, how in MEASURES.items()]))
    return stats.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with a fence for each measure, from the group's, language's or whole sketch."""
    levels = []
    for level, keys in (("own", ["lang", "source"]), ("language", ["lang"]), ("all", [])):
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        cum = merged.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        at = lambda percent: bucket_top(F.min(F.when(F.col("cum") * 100 >= F.col("total") * percent, F.col("bucket"))))
        q = cum.groupBy(*keys, "measure", "total").agg(at(50).alias("q50"), at(75).alias("q75"), at(99).alias("q99"))
        share = F.create_map(*[x for m, how in MEASURES.items() for x in (F.lit(m), F.lit(how[3]))])[F.col("measure")]
        spread, floor = F.col("q75") + SPREADS * (F.col("q75") - F.col("q50")), F.floor(share * F.col("q99") / 100)
        maps = [F.map_from_entries(F.collect_list(F.struct("measure", x.alias("v")))).alias(f"{name}_{level}") for name, x in (("spread", spread), ("floor", floor))]  # of six
        levels.append(q.groupBy(*keys).agg(F.max("total").alias(f"n_{level}"), *maps))
    own, lang, whole = levels
    lang = lang.withColumnRenamed("lang", "__lang")
    row = whole.first()  # one row of twelve numbers
    out = own.join(lang, own["lang"].eqNullSafe(lang["__lang"]))
    for name in ("spread", "floor"):
        every = F.create_map(*[x for m, v in sorted(row[f"{name}_all"].items()) for x in (F.lit(m), F.lit(v).cast("long"))]) if row else F.lit(None)
        out = out.withColumn(f"{name}_all", every.cast("map<string,bigint>"))
    large = F.col("n_language") >= min_docs
    spread = F.when(F.col("n_own") >= min_docs, F.col("spread_own")).when(large, F.col("spread_language")).otherwise(F.col("spread_all"))
    floor = F.when(large, F.col("floor_language")).otherwise(F.col("floor_all"))
    return out.select("lang", "source", F.map_zip_with(spread, floor, lambda _, a, b: F.greatest(a, b) + TOLERANCE).alias("__fences"))


def base_failed():
    n = F.col("__q_n_words")
    return (n < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _verdict():
    ok = ~base_failed()
    for m, how in MEASURES.items():
        ok = ok & (_measure(*how[:3]) <= F.col("__fences")[m])
    return ok


def quality_rules(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the counts, base_failed and kept, a row per document."""
    with Workspace(spark, "rules") as ws:
        stats = ws.stage(document_stats(docs, ["doc_id", "lang", "source"]))
        limits = ws.stage(fences(ws.stage(sketches(stats)), min_docs))
        judged = small_join(stats, limits, ["lang", "source"])
        return ws.keep(judged.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in COUNTS[:5]], base_failed().alias("base_failed"), _verdict().alias("kept")))


def filter_quality(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are read twice (for the sketches, then for the verdicts) and never shuffled.
    """
    with Workspace(spark, "rules") as ws:
        limits = ws.keep(fences(ws.stage(sketches(document_stats(docs, ["lang", "source"]))), min_docs))
    stats = document_stats(docs, docs.columns)
    return small_join(stats, limits, ["lang", "source"]).where(_verdict()).select(*docs.columns)
