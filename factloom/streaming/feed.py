"""Applying a feed of per-commit deltas in order: one micro-batch per commit, exactly once by the store's watermark.

The store's fingerprint is a chain over the contents of the commits, so a feed whose applied part has been rewritten is refused. A
commit with a null key or two values of a key is set aside as skipped, and the ones after it go on.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.temporal import scd2_changes
from factloom.plans.indexer import HistoryChanged
from factloom.plans.store import Changes, Store


def contents(rows: DataFrame, key: str, value: str) -> dict[int, str]:
    """A digest of each commit's rows (seq, key, value), whatever their order: a line per commit."""
    each = F.xxhash64(key, value)
    sums = rows.groupBy("seq").agg(F.count("*").alias("n"), F.sum(each.cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(each)).alias("b"))
    return {r["seq"]: f"{r['n']}:{r['a']}:{r['b']}" for r in sums.collect()}


def link(before: str | None, seq: int, content: str) -> str:
    return hashlib.sha256(f"{before or ''}\n{seq}\n{content}\n".encode()).hexdigest()


def check_feed(store: Store, rows: DataFrame, key: str, value: str) -> None:
    """Refuses a feed whose commits up to the watermark are not those that were applied."""
    mark, done = None, store.manifest["last_applied_seq"]
    for seq, content in sorted(contents(rows.where(F.col("seq") <= done), key, value).items()):
        mark = link(mark, seq, content)
    if mark != store.manifest["fingerprint"]:
        raise HistoryChanged(f"the feed up to commit {done} is not the one that was applied")


def poison(rows: DataFrame, key: str, value: str) -> str | None:
    """Why a commit's rows (key, value) cannot be applied, or None."""
    seen = rows.groupBy(key).agg(F.count_distinct(F.struct(value)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    bad = seen.agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count("*").alias("all")).first()
    return "null_key" if bad["nulls"] else "ambiguous_key" if bad["all"] else None


def follow(spark: SparkSession, path: str, schema: str, store: Store, checkpoint: str, key: str, value: str, name: str = "versions") -> None:
    """Reads all commits there are (files with columns seq, key, value, one commit each) and maintains an interval table."""
    if store.resume_from():
        check_feed(store, spark.read.schema(schema).parquet(path), key, value)

    def batch(df: DataFrame, _id: int) -> None:
        for seq, content in sorted(contents(df, key, value).items()):  # one file, so one commit, per batch
            rows = df.where(df["seq"] == seq).select(key, value).distinct()

            def make(s: Store, seq: int = seq, rows: DataFrame = rows) -> dict[str, Changes]:
                old = s.live(name)
                if old is None:
                    old = spark.createDataFrame([], f"{key} string, {value} string, valid_from long, valid_to long")
                return {name: Changes(scd2_changes(old, rows, key, value, seq, close_missing=True), [key])}

            store.apply_delta(seq, link(store.manifest["fingerprint"], seq, content), make, skipped=poison(rows, key, value))

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
