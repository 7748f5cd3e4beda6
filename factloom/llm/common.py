"""Helpers shared by the corpus operators: staged tables, shared files, sizes of small tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a table that may be broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 20_000
#: Copies of the small side in a salted join.
SALTS = 32
#: Rows for which a task of its own is worth starting, and the tasks of small tables.
TASK_ROWS = 2_000
LEAST_TASKS = 12

_OWN_DIRS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(_forget)
    return _OWN_DIRS[0]


#: Tables that outlive their workspaces; they are removed when Python ends, if the session is still there.
_KEPT: dict[str, Workspace] = {}


@atexit.register
def _forget_kept() -> None:
    for ws in list(_KEPT.values()):
        if ws.spark.sparkContext._jsc is not None and not ws.spark.sparkContext._jsc.sc().isStopped():
            ws.forget()


def _forget() -> None:
    for uri in _OWN_DIRS:
        fs, path = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


class Workspace:
    """A run's own folder in the shared folder.

    ``stage`` writes a table as Parquet and reads it again, which cuts the lineage and survives the loss of
    executors. Leaving the context removes all that was staged, but for what ``keep`` returned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/factloom/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_exc) -> None:
        self.drop(self.uri)

    def drop(self, uri: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, df: DataFrame, uri: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(uri)
        return self.spark.read.schema(df.schema).parquet(uri)

    def stage(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a table; where it is known to come of about ``rows`` rows these are left to as few tasks as they need."""
        self._n += 1
        if rows is not None:
            df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
        return self._write(df, f"{self.uri}/t{self._n}")

    def keep(self, df: DataFrame) -> DataFrame:
        """A staged table that outlives the workspace, until ``forget`` or the end of Python."""
        self._n += 1
        out = self._write(df, f"{self.uri}-result/t{self._n}")
        _KEPT[self.uri] = self
        return out

    def forget(self) -> None:
        """Removes what ``keep`` returned."""
        self.drop(f"{self.uri}-result")
        _KEPT.pop(self.uri, None)


def small_join(left: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join with a table that is usually small: broadcast after a count, else salted on both sides.

    The small side has one row per key, its key columns are dropped from the result.
    """
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in small.columns])
    on = [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = left.join(F.broadcast(renamed), on, how)
    else:
        salted = renamed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("__own_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
        on = [left[k].eqNullSafe(salted[f"__k_{k}"]) for k in keys]
        out = left.join(salted, [*on, left["__own_salt"] == salted["__salt"]], how).drop("__salt", "__own_salt")
    return out.drop(*[f"__k_{k}" for k in keys])


def open_fs(uri: str):
    """(filesystem, path) of a folder in the shared store, from driver or executor."""
    return pafs.FileSystem.from_uri(uri)


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Values of a binary or string column as bytes; null as empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def table(like: pa.RecordBatch, drop: tuple[str, ...] = (), **columns) -> pa.RecordBatch:
    """The batch without some columns and with others added."""
    names = [n for n in like.schema.names if n not in drop]
    arrays = [like.column(n) for n in names]
    for name, values in columns.items():
        names.append(name)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MUL = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> np.ndarray:
    """1, m, m^2 ... (mod 2^64), at least n of them."""
    if not _powers or len(_powers[0]) < n:
        p = np.full(max(n, 1 << 16), _MUL, np.uint64)
        p[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64)]
    return _powers[0]


_inverse: list[np.ndarray] = []


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of powers(n) mod 2^64."""
    if not _inverse or len(_inverse[0]) < n:
        p = np.full(max(n, 1 << 16), pow(_MUL, -1, 1 << 64), np.uint64)
        p[0] = 1
        _inverse[:] = [np.cumprod(p, dtype=np.uint64)]
    return _inverse[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times an inverse power, are the hashes of substrings (mod 2^64)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the substrings [start, end)."""
    return mix64((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start])
