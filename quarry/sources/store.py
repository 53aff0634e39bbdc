"""Versioned tables: Parquet folders named by manifests.

A manifest lists every table: its columns, key, indexes and the folders that hold its rows. A commit writes the next manifest
under a number that nobody has taken, so of two writers one fails; readers keep the manifest that they have read. That needs a
file system which creates a file only if there is none, as HDFS and local ones do; on others one engine may write. Folders that no
manifest names are left over from what was rolled back or lost, and vacuum removes them. All files go through Hadoop's file
systems, so a warehouse may lie in any of them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from copy import deepcopy
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import SqlError
from quarry.functions import spatial
from quarry.functions.types import field as column_field

HEAP, SEQUENTIAL = "HEAP", "SEQUENTIAL"
#: Side of a grid cell, in the unit of the points, by which an index of points sorts.
CELL = 0.05
#: More files than so many are sorted by an exchange where an order is asked for.
FILES_IN_ORDER = 64
#: A SEQUENTIAL table is rewritten when later folders hold more than this share of its first one's bytes, or are MANY.
LOOSE, MANY = 0.3, 8


@dataclass
class Entry:
    """A table in a manifest."""

    columns: list[tuple[str, str]]
    key: str
    organisation: str = HEAP
    parts: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream that is in the table

    @property
    def schema(self) -> T.StructType:
        return T.StructType([column_field(n, k) for n, k in self.columns])


def sorted_by(entry: Entry) -> str | None:
    """The column that a table's files are sorted by: its key if SEQUENTIAL, else that of its first BTREE or BITMAP index, unless
    an RTREE sorts them by cells."""
    if entry.organisation == SEQUENTIAL:
        return entry.key
    if any(i["kind"] == "RTREE" for i in entry.indexes):
        return None
    return next((i["column"] for i in entry.indexes if i["kind"] in ("BTREE", "BITMAP")), None)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _read(self, name: str) -> str:
        source = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _write(self, name: str, text: str) -> None:
        """A new file; fails if there is one."""
        out = self.fs.create(self._path(f"{self.root}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def latest(self) -> tuple[int, dict[str, Entry]]:
        """The newest manifest that was written whole."""
        for n in sorted((int(x.split(".")[0]) for x in self._names("manifests") if x.endswith(".json")), reverse=True):
            body = self._read(f"manifests/{n:012d}.json")
            head, _, rest = body.partition("\n")
            if head == str(zlib.crc32(rest.encode())):
                return n, {k: Entry(**(v | {"columns": [tuple(c) for c in v["columns"]]})) for k, v in json.loads(rest).items()}
        return 0, {}

    def commit(self, after: int, tables: dict[str, Entry]) -> int:
        body = json.dumps({k: asdict(v) for k, v in sorted(tables.items())})
        try:
            self._write(f"manifests/{after + 1:012d}.json", f"{zlib.crc32(body.encode())}\n{body}")
        except Exception as e:
            raise SqlError("transaction", "another session has committed meanwhile") from e
        return after + 1

    def frame(self, entry: Entry) -> DataFrame:
        if not entry.parts:
            return self.spark.createDataFrame([], entry.schema)
        return self.spark.read.schema(entry.schema).parquet(*(f"{self.root}/{p}" for p in entry.parts))

    def write(self, table: str, df: DataFrame, entry: Entry) -> str:
        """A new folder with these rows, laid out as the table's organisation and indexes ask.

        Rows are sorted by one column, or by the cells of one; other indexed columns get Bloom filters for equality.
        """
        part = f"data/{table}/{uuid.uuid4().hex}"
        by = []
        if column := sorted_by(entry):
            by = [F.col(f"`{column}`")]
        elif found := [i for i in entry.indexes if i["kind"] == "RTREE"]:
            by = [spatial.cell(F.col(f"`{found[0]['column']}`"), CELL)]
        if by:
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        writer, kinds = df.write, {f.name: f.dataType for f in entry.schema.fields}
        for c in {i["column"] for i in entry.indexes if i["kind"] != "RTREE"} - {sorted_by(entry)}:
            if not isinstance(kinds[c], T.BooleanType):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{part}")
        return part

    def in_order(self, entry: Entry, descending: bool = False) -> DataFrame | None:
        """The rows by the column that files are sorted by, ties by the key, without an exchange; None where that cannot be.

        The files of one folder hold ranges that follow each other, equal values in one file, so each is a task that sorts its
        own rows.
        """
        if len(entry.parts) != 1 or not (column := sorted_by(entry)):
            return None
        names = sorted(n for n in self._names(entry.parts[0]) if n.startswith("part-"))
        if not 0 < len(names) <= FILES_IN_ORDER:
            return None
        by = F.col(f"`{column}`")
        frames = [self.spark.read.schema(entry.schema).parquet(f"{self.root}/{entry.parts[0]}/{n}").coalesce(1) for n in (reversed(names) if descending else names)]
        return reduce(DataFrame.unionAll, [f.sortWithinPartitions(by.desc() if descending else by.asc(), F.col(f"`{entry.key}`").asc()) for f in frames])

    def size(self, part: str) -> int:
        """Bytes of a folder."""
        return self.fs.getContentSummary(self._path(f"{self.root}/{part}")).getLength()

    def remove(self, part: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{part}"), True)

    def vacuum(self) -> list[str]:
        """Remove folders that the newest manifest does not name, and older manifests; returns the folders."""
        n, tables = self.latest()
        named, gone = {p for e in tables.values() for p in e.parts}, []
        for table in self._names("data"):
            for part in self._names(f"data/{table}"):
                if f"data/{table}/{part}" not in named:
                    self.fs.delete(self._path(f"{self.root}/data/{table}/{part}"), True)
                    gone.append(f"data/{table}/{part}")
        for x in self._names("manifests"):
            if x.endswith(".json") and int(x.split(".")[0]) < n:
                self.fs.delete(self._path(f"{self.root}/manifests/{x}"), False)
        return gone

    def log(self, transaction: str, events: list[dict]) -> None:
        """A transaction's events, each with the checksum of its text."""
        lines = []
        for e in events:
            body = json.dumps(e, sort_keys=True)
            lines.append(f"{zlib.crc32(body.encode())} {body}")
        self._write(f"log/{transaction}.log", "\n".join(lines))

    def events(self) -> list[dict]:
        """All logged events, by transaction; a last line that was cut short is left out, any other broken line raises."""
        out = []
        for name in sorted(self._names("log")):
            if not name.endswith(".log"):
                continue
            lines = self._read(f"log/{name}").split("\n")
            for i, line in enumerate(lines):
                check, _, body = line.partition(" ")
                if check != str(zlib.crc32(body.encode())):
                    if i == len(lines) - 1:
                        break
                    raise SqlError("transaction", f"line {i + 1} of {name} is broken")
                out.append(json.loads(body))
        return out

    def copy(self, tables: dict[str, Entry]) -> dict[str, Entry]:
        return deepcopy(tables)
