"""What is printed or handed on: paths, summaries, JSON, speed-ups, short names of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_paths(changes: DataFrame) -> DataFrame:
    """(path) of changes (path, symbol, change)."""
    return changes.select("path").distinct()


def summary(changes: DataFrame) -> DataFrame:
    """(path, summary): a line per file, `path: symbol (change), ...` by symbol."""
    each = F.array_sort(F.collect_list(F.struct("symbol", "change")))
    words = F.transform(each, lambda x: F.concat(x["symbol"].cast("string"), F.lit(" ("), x["change"], F.lit(")")))
    return changes.groupBy("path").agg(F.concat(F.col("path"), F.lit(": "), F.array_join(words, ", ")).alias("summary"))


def average_speedup(runs: DataFrame) -> DataFrame:
    """One row: the mean of full over incremental time of the runs (passed, full_ms, incremental_ms) that passed and took time; null if none did."""
    counts = F.col("passed") & (F.col("full_ms") > 0) & (F.col("incremental_ms") > 0)
    return runs.agg(F.avg(F.when(counts, F.col("full_ms") / F.col("incremental_ms"))).alias("speedup"))


def as_json(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(json): an object for each value of ``by``, with the sorted list of ``value``."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias(value)).select(F.to_json(F.struct(by, value)).alias("json"))


def write_json(rows: DataFrame, path: str, pretty: bool = False) -> None:
    """A line per row, or indented objects one after the other."""
    if pretty:
        rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value")).write.text(path)
    else:
        rows.write.json(path)


def resolve_commit(commits: DataFrame, prefix: str) -> str:
    """The one commit hash that begins with ``prefix`` (hex, any case)."""
    prefix = prefix.strip().lower()
    if not prefix or any(c not in "0123456789abcdef" for c in prefix):
        raise ValueError(f"{prefix!r} is no commit hash")
    found = commits.where(F.col("commit_hash").startswith(prefix)).select("commit_hash").distinct().limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found) and 'several commits' or 'no commit'} for {prefix!r}")
    return found[0]["commit_hash"]
