"""Snapshots of tables, a folder per repository and commit: write, read, copy and delete one, leaving all others alone."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Tables under a root folder as <name>/repo=<repo>/commit=<commit>; columns repo and commit are not stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _uri(self, name: str, repo: str, commit: str) -> str:
        return f"{self.root}/{name}/repo={quote(repo, safe='')}/commit={quote(commit, safe='')}"

    def _path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, name: str, repo: str, commit: str, rows: DataFrame) -> None:
        """Replaces the snapshot."""
        rows.write.mode("overwrite").parquet(self._uri(name, repo, commit))

    def read(self, name: str, repo: str, commit: str) -> DataFrame | None:
        path, fs = self._path(self._uri(name, repo, commit))
        return self.spark.read.parquet(self._uri(name, repo, commit)) if fs.exists(path) else None

    def copy(self, names: list[str], repo: str, old: str, new: str) -> None:
        """Makes the snapshots of one commit those of another, without reading rows that have gone."""
        for name in names:
            if (rows := self.read(name, repo, old)) is not None:
                self.write(name, repo, new, rows)

    def delete(self, names: list[str], repo: str, commit: str) -> int:
        """Removes a commit's snapshots; how many there were."""
        gone = 0
        for name in names:
            path, fs = self._path(self._uri(name, repo, commit))
            gone += fs.delete(path, True)
        return gone
