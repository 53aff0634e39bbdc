"""What the operators share: working tables in the cluster's shared folder, shipped code, text batches."""

from __future__ import annotations

import ctypes
import gc
import io
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes of text that a Python worker turns into Python strings at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")

        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """Where this application's working tables lie."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"


_scratch = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_scratch, "open", [])[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that are named inside go at the end; what is still to be read must be kept under a path from outside."""
    _scratch.open = [*getattr(_scratch, "open", []), []]
    try:
        yield
    finally:
        *_scratch.open, paths = _scratch.open
        for path in paths:
            drop(spark, path)


def sweep(spark: SparkSession) -> None:
    """Remove all working tables of this application; results that have not been read yet are lost."""
    drop(spark, own_dir(spark))


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, through the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark)}/quarry/code-{uuid.uuid4().hex}/quarry_code.zip"
    fs, p = hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that a table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(c: str | Column) -> Column:
    """A text column as its bytes, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch that hold about SLICE_BYTES of the given column, one row at least."""
    n, at = batch.num_rows, 0
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    while at < n:
        end, size = at, 0
        while end < n and (end == at or size + lengths[end] <= SLICE_BYTES):
            size += int(lengths[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return [x.decode("utf-8", "replace") for x in batch.column(column).to_pylist()]


#: Rows without an id are counted from here on: beyond all real ids.
NO_ID = (1 << 63) - (1 << 40)


def id_below(most: int, name: str) -> Column:
    """An id column; an id from `most` on fails the job."""
    c = F.col(name).cast("long")
    return F.when(c.isNull() | (c < most), c).otherwise(F.raise_error(F.concat(F.lit(f"{name} must lie below {most}: "), c.cast("string"))).cast("long")).alias(name)


def as_binary(a: pa.Array) -> tuple:
    """The offsets and the bytes of a binary array."""
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Bounded(dict):
    """A cache that is emptied when it holds more than `most` entries; results never depend on it."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self) -> None:
        if len(self) > self.most:
            self.clear()


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """A worker's own object, such as a cache of words. It outlives a task and goes when a task needs another one."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # hand the memory back where the C library can
                trim(0)
        _held[key] = make()
    return _held[key]


class Numbers(dict):
    """Numbers of keys by the order in which they come; looking up a new key gives it the next one."""

    def __init__(self):
        super().__init__()
        self.next, self.first, self.new = 0, 0, []

    def __missing__(self, key):
        self[key] = n = self.next
        self.next = n + 1
        self.new.append(key)
        return n

    def fresh(self) -> tuple[list, np.ndarray]:
        """The keys that have come since the last call, and their numbers."""
        new, first = self.new, self.first
        self.new, self.first = [], self.next
        return new, np.arange(first, self.next)


class Pool:
    """Runs of values by number, in one growing array."""

    def __init__(self, dtype: type):
        self.values, self.used = np.zeros(1 << 12, dtype), 0
        self.starts, self.lengths = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    @classmethod
    def of(cls, numbers: list[int], lengths: np.ndarray, values: np.ndarray) -> Pool:
        out = cls(values.dtype)
        out.put(np.array(numbers), lengths, values)
        out.starts, out.lengths = out.starts[: len(numbers)], out.lengths[: len(numbers)]
        return out

    def put(self, numbers: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        if not len(numbers):
            return
        if (n := int(numbers.max()) + 1) > len(self.starts):
            more = np.zeros(2 * n - len(self.starts), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        end = self.used + len(values)
        if end > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(2 * end - self.used, self.values.dtype)])
        self.values[self.used : end] = values
        self.starts[numbers], self.lengths[numbers] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used = end

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the runs of these numbers, and their values one after the other."""
        lengths = self.lengths[numbers]
        shift = self.starts[numbers] - (np.cumsum(lengths) - lengths)
        at = np.repeat(shift, lengths)
        at += np.arange(len(at))
        return lengths, self.values[at]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
