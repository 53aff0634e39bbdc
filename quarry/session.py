"""Sessions: statements in, results out."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.errors import SqlError
from quarry.functions import spatial
from quarry.functions.types import POINT, value
from quarry.plans import explain, planner
from quarry.plans import tree as t
from quarry.plans.parser import parse
from quarry.sources import constraints
from quarry.sources.locks import EXCLUSIVE, SHARED, UPDATE, Locks
from quarry.sources.store import LOOSE, MANY, SEQUENTIAL, Entry, Store, sorted_by

SYSTEM = {
    "sys_tables": "table_id int, table_name string, organisation string, primary_key string",
    "sys_columns": "table_id int, column_name string, type string, column_order int, is_primary_key boolean",
    "sys_indexes": "index_name string, table_name string, column_name string, kind string, clustered boolean",
}


@dataclass
class Result:
    """What a statement gives: a message, and rows or a count of rows."""

    message: str
    df: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    affected_rows: int | None = None

    def rows(self) -> list[Row]:
        return self.df.collect() if self.df is not None else []


@dataclass
class Open:
    """A transaction: the manifest that it began with, its tables, the rows that it inserted and has not written, its events."""

    id: str
    number: int
    tables: dict[str, Entry]
    pending: dict[str, list[tuple]] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)


class Engine:
    """A warehouse folder that sessions share."""

    def __init__(self, spark: SparkSession, root: str, patience: float = 5.0):
        self.spark, self.store, self.locks = spark, Store(spark, root), Locks(patience)
        self.commits = threading.Lock()
        self.views: dict[str, planner.Table] = {}
        self.live: set[str] = set()
        self.recovered: list[str] | None = None

    def session(self) -> Session:
        return Session(self)

    def attach(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A table that statements can read and not change."""
        self.views[name] = planner.Table(name, df, key)

    def transactions(self) -> DataFrame:
        """Every logged transaction and what became of it."""
        by: dict[str, list[dict]] = {}
        for e in self.store.events():
            by.setdefault(e["transaction"], []).append(e)
        ends = {"COMMIT": "committed", "ABORT": "aborted"}
        rows = [(k, ends.get(v[-1]["type"], "active" if k in self.live else "lost"), len(v)) for k, v in by.items()]
        return self.spark.createDataFrame(rows, "transaction string, status string, events int")

    def events(self) -> DataFrame:
        rows = [(e["transaction"], i, e["type"], e.get("table"), e.get("rows")) for i, e in enumerate(self.store.events())]
        return self.spark.createDataFrame(rows, "transaction string, number int, type string, table string, rows long")

    def health(self) -> dict[str, object]:
        """Whether the warehouse can be read, its newest manifest, and what is open."""
        try:
            number, tables = self.store.latest()
            status = "ok"
        except Exception as e:  # whatever the file system raises
            number, tables, status = None, {}, f"failing: {e}"
        return {"status": status, "manifest": number, "tables": len(tables), "open_transactions": len(self.live), "locks": len(self.locks.listing())}

    def recovery_status(self) -> DataFrame:
        """What the last recover() of this engine found: each folder that it removed; none before the first."""
        return self.spark.createDataFrame([(x,) for x in self.recovered or []], "folder string")

    def lock_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.locks.listing(), "table string, owner string, mode string")

    def recover(self) -> list[str]:
        """After a crash: what was committed is there; folders of transactions that never ended are removed."""
        self.recovered = self.store.vacuum()
        return self.recovered


class Session:
    """Runs statements one after the other; a failing one aborts the open transaction."""

    def __init__(self, engine: Engine):
        self.engine, self.spark, self.store = engine, engine.spark, engine.store
        self.open: Open | None = None
        self.name = f"session-{uuid.uuid4().hex[:8]}"

    def __str__(self) -> str:
        return self.name

    def sql(self, text: str) -> list[Result]:
        out = []
        try:
            for s in parse(text):
                out.append(self.run(s))
        except BaseException:
            if self.open:
                self._finish("ABORT")
            raise
        finally:
            if not self.open:
                self.engine.locks.free(self)
        return out

    def one(self, text: str) -> Result:
        return self.sql(text)[-1]

    # --- what is there

    def _state(self) -> tuple[int, dict[str, Entry]]:
        return (self.open.number, self.open.tables) if self.open else self.store.latest()

    def _frame(self, name: str, entry: Entry) -> DataFrame:
        df = self.store.frame(entry)
        rows = self.open.pending.get(name) if self.open else None
        return df.unionByName(self.spark.createDataFrame(rows, entry.schema)) if rows else df

    def _entry(self, name: str, tables: dict[str, Entry]) -> Entry:
        if name in tables:
            return tables[name]
        if name in SYSTEM or name in self.engine.views:
            raise SqlError("semantic", f"table {name} cannot be changed")
        raise SqlError("semantic", f"no table {name}")

    def system(self, name: str) -> DataFrame:
        _, tables = self._state()
        rows: list[tuple] = []
        for i, (table, e) in enumerate(sorted(tables.items())):
            if name == "sys_tables":
                rows.append((i, table, e.organisation, e.key))
            elif name == "sys_columns":
                rows += [(i, c, kind, k, c == e.key) for k, (c, kind) in enumerate(e.columns)]
            else:
                rows += [(x["name"], table, x["column"], x["kind"], x["clustered"]) for x in e.indexes]
        return self.spark.createDataFrame(rows, SYSTEM[name])

    def _table(self, name: str, e: Entry) -> planner.Table:
        pending = self.open and self.open.pending.get(name)
        in_order = lambda descending: None if pending else self.store.in_order(e, descending)
        return planner.Table(name, self._frame(name, e), e.key, e.organisation == SEQUENTIAL, sorted_by(e), in_order)

    def tables(self, names: Iterable[str] | None = None) -> dict[str, planner.Table]:
        """Those of these names that there are, or all."""
        _, stored = self._state()
        wanted = {*stored, *SYSTEM, *self.engine.views} if names is None else set(names)
        out = {n: planner.Table(n, self.system(n)) for n in SYSTEM if n in wanted}
        out |= {n: v for n, v in self.engine.views.items() if n in wanted}
        return out | {n: self._table(n, e) for n, e in stored.items() if n in wanted}

    def spatial_points(self, name: str) -> DataFrame:
        return spatial.points_of(self.tables([name])[name].frame)

    # --- statements

    def run(self, s: object) -> Result:
        kind = type(s)
        if kind is t.Select:
            return self._select(s)
        if kind is t.Explain:
            return self._explain(s)
        if kind is t.Begin:
            return self._begin()
        if kind in (t.End, t.Rollback):
            if not self.open:
                raise SqlError("transaction", "no transaction is open")
            self._finish("COMMIT" if kind is t.End else "ABORT")
            return Result("transaction committed" if kind is t.End else "transaction rolled back")
        self.engine.locks.take(self, s.table, UPDATE if kind is t.Update else EXCLUSIVE)
        number, tables = self._state()
        if not self.open:
            tables = self.store.copy(tables)
        out = {t.CreateTable: self._create, t.DropTable: self._drop, t.CreateIndex: self._index, t.Insert: self._insert, t.Delete: self._delete, t.Update: self._update}[kind](s, tables)
        if self.open:
            self.open.events.append({"transaction": self.open.id, "type": kind.__name__.upper(), "table": s.table, "rows": out.affected_rows})
        else:
            if kind is t.Insert:
                self._settle(s.table, tables[s.table])
            with self.engine.commits:
                self.store.commit(self._rebase(number, tables, {s.table}), tables)
        return out

    def _settle(self, name: str, e: Entry) -> None:
        """Rewrite a SEQUENTIAL table in one folder when much of it lies in later ones."""
        if e.organisation == SEQUENTIAL and len(e.parts) > 1:
            sizes = [self.store.size(p) for p in e.parts]
            if len(sizes) > MANY or sum(sizes[1:]) > LOOSE * sizes[0]:
                self._rewrite(name, e)

    def _change(self, table: str, what: str, work: Callable[[Entry], object]) -> object:
        """A change through the API: under the table's lock, part of an open transaction or committed at once."""
        self.engine.locks.take(self, table, EXCLUSIVE)
        try:
            number, tables = self._state()
            tables = tables if self.open else self.store.copy(tables)
            out = work(self._entry(table, tables))
            if self.open:
                self.open.events.append({"transaction": self.open.id, "type": what, "table": table, "rows": out if isinstance(out, int) else None})
            else:
                with self.engine.commits:
                    self.store.commit(self._rebase(number, tables, {table}), tables)
            return out
        finally:
            if not self.open:
                self.engine.locks.free(self)

    def _rebase(self, number: int, tables: dict[str, Entry], own: set[str]) -> int:
        """Take over what others have committed to other tables since; locks keep them off ours."""
        latest, theirs = self.store.latest()
        if latest != number:
            for name in (tables.keys() | theirs.keys()) - own:
                tables.pop(name, None)
                if name in theirs:
                    tables[name] = theirs[name]
        return latest

    def _begin(self) -> Result:
        if self.open:
            raise SqlError("transaction", "a transaction is open")
        number, tables = self.store.latest()
        self.open = Open(uuid.uuid4().hex, number, self.store.copy(tables))
        self.engine.live.add(self.open.id)
        self.open.events.append({"transaction": self.open.id, "type": "BEGIN"})
        return Result("transaction begun")

    def _finish(self, how: str) -> None:
        done = self.open
        try:
            if how == "COMMIT":
                for name in list(done.pending):
                    self._flush(name, done.tables[name])
                own = {e["table"] for e in done.events if "table" in e}
                if own:
                    with self.engine.commits:
                        self.store.commit(self._rebase(done.number, done.tables, own), done.tables)
            done.events.append({"transaction": done.id, "type": how})
        except BaseException:
            done.events.append({"transaction": done.id, "type": "ABORT"})
            raise
        finally:
            self.open = None
            self.engine.live.discard(done.id)
            self.store.log(done.id, done.events)
            self.engine.locks.free(self)

    def _flush(self, name: str, entry: Entry) -> None:
        rows = self.open.pending.pop(name, None) if self.open else None
        if rows:
            entry.parts.append(self.store.write(name, self.spark.createDataFrame(rows, entry.schema).coalesce(1), entry))

    def _select(self, s: t.Select) -> Result:
        names = {s.table} | ({s.join[0]} if s.join else set())
        self.engine.locks.take_all(self, dict.fromkeys(names, SHARED))
        df, columns = planner.select(s, self.tables(names))
        return Result("rows", df, columns)

    def _explain(self, e: t.Explain) -> Result:
        began = time.perf_counter()
        _, tables = self._state()

        if isinstance(e.statement, t.Select):
            self.engine.locks.take_all(self, dict.fromkeys({e.statement.table, *(e.statement.join or [])[:1]}, SHARED))

        def info(name: str) -> tuple[int, int, dict[str, list[str]]]:
            known = self.tables([name])
            if name not in known:
                raise SqlError("semantic", f"no table {name}")
            indexes: dict[str, list[str]] = {}
            for x in tables[name].indexes if name in tables else []:
                indexes.setdefault(x["column"], []).append(x["name"])
            frame = known[name].frame
            size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            width = frame.schema.json().count('"name"') * 8
            return min(size // max(1, width), 10**12), width, indexes

        s = e.statement
        node = explain.build(s, info)
        physical: list[str] = []
        frame = None
        if isinstance(s, t.Select):
            frame, _ = planner.select(s, self.tables({s.table, *(s.join or [])[:1]}))
            physical = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        planned = (time.perf_counter() - began) * 1000
        tail = [f"Planning Time: {planned:.3f} ms"]
        if e.analyze:
            began = time.perf_counter()
            rows = frame.count() if frame is not None else self.run(s).affected_rows or 0
            took = (time.perf_counter() - began) * 1000
            node.actual = f" (actual time=0.000..{took:.3f} rows={rows} loops=1)"
            for child in _scans(node):
                if isinstance(s, t.Select) and s.where is not None and not s.join and any(x.startswith("Filter") for x in child.notes):
                    whole = self.tables([s.table])[s.table].frame.count()
                    kept = planner.select(t.Select(None, s.table, where=s.where), self.tables([s.table]))[0].count()
                    child.actual = f" (actual rows={kept} loops=1)"
                    child.notes.append(f"Rows Removed by Filter: {whole - kept}")
            tail.append(f"Execution Time: {took:.3f} ms")
        text = explain.lines(node) + tail + [f"  {x}" for x in physical]
        return Result("plan", self.spark.createDataFrame([(x,) for x in text], "`QUERY PLAN` string"), ["QUERY PLAN"])

    def _create(self, s: t.CreateTable, tables: dict[str, Entry]) -> Result:
        if s.table in tables or s.table in SYSTEM or s.table in self.engine.views:
            raise SqlError("semantic", f"table {s.table} is there already")
        names = [c for c, _, _ in s.columns]
        if len(set(names)) != len(names):
            raise SqlError("semantic", "two columns share a name")
        keys = [c for c, _, k in s.columns if k]
        if not keys:
            raise SqlError("semantic", "a table needs a PRIMARY KEY")
        if dict((c, k) for c, k, _ in s.columns)[keys[0]] == "point":
            raise SqlError("semantic", "a POINT is no PRIMARY KEY")
        tables[s.table] = Entry([(c, k) for c, k, _ in s.columns], keys[0], s.organisation)
        return Result(f"table {s.table} created")

    def _drop(self, s: t.DropTable, tables: dict[str, Entry]) -> Result:
        self._entry(s.table, tables)
        del tables[s.table]
        if self.open:
            self.open.pending.pop(s.table, None)
        return Result(f"table {s.table} dropped")

    def _index(self, s: t.CreateIndex, tables: dict[str, Entry]) -> Result:
        e = self._entry(s.table, tables)
        kinds = dict(e.columns)
        if s.column not in kinds:
            raise SqlError("semantic", f"no column {s.column}")
        if (s.kind == "RTREE") != (kinds[s.column] == "point"):
            raise SqlError("semantic", "an RTREE is for a POINT column, other indexes are not")
        if s.kind == "RTREE" and s.clustered:
            raise SqlError("semantic", "an RTREE cannot be CLUSTERED")
        if s.kind in ("RTREE", "HASH", "BITMAP") and e.organisation == SEQUENTIAL:
            raise SqlError("semantic", f"an index by {s.kind} is for a HEAP table")
        if s.clustered and (e.organisation != SEQUENTIAL or s.column != e.key):
            raise SqlError("semantic", "a CLUSTERED index is for the key of a SEQUENTIAL table")
        suffix = "clustered" if s.clustered else "unclustered" if s.kind == "BTREE" else s.kind.lower()
        name = f"idx_{s.table}_{s.column}_{suffix}"
        if any(x["name"] == name for x in e.indexes):
            raise SqlError("semantic", f"index {name} is there already")
        e.indexes.append({"name": name, "column": s.column, "kind": s.kind, "clustered": s.clustered})
        self._rewrite(s.table, e)
        return Result(f"index {name} created")

    def _rewrite(self, name: str, e: Entry, df: DataFrame | None = None) -> None:
        df = self._frame(name, e) if df is None else df
        part = self.store.write(name, df, e)
        if self.open:
            self.open.pending.pop(name, None)
        e.parts = [part]

    def drop_index(self, name: str) -> None:
        """Remove an index by its name; rows stay as they lie."""
        table = next((n for n, e in self._state()[1].items() if any(x["name"] == name for x in e.indexes)), None)
        if table is None:
            raise SqlError("semantic", f"no index {name}")

        def drop(e: Entry) -> None:
            e.indexes = [x for x in e.indexes if x["name"] != name]

        self._change(table, "DROPINDEX", drop)

    def constrain(self, table: str, not_null: list[str] = (), unique: list[str] = (), checks: dict[str, str] | None = None) -> None:
        """Add constraints: columns without nulls, columns without repeats, and named SQL predicates. The rows must hold them."""

        def add(e: Entry) -> None:
            e.not_null, e.unique, e.checks = [*e.not_null, *not_null], [*e.unique, *unique], e.checks | (checks or {})
            self._hold(e, self._frame(table, e))

        self._change(table, "CONSTRAIN", add)

    def _hold(self, e: Entry, df: DataFrame, columns: set[str] | None = None) -> None:
        """Raise if rows break a constraint; `columns`: the only ones whose repeats need a look."""
        for c in [e.key, *e.not_null]:
            if not constraints.nulls(df, c).isEmpty():
                raise SqlError("constraint", f"column {c} must not be null")
        for c in [e.key, *e.unique]:
            if (columns is None or c in columns) and not constraints.duplicates(df.select(f"`{c}`"), c).isEmpty():
                raise SqlError("constraint", f"column {c} must not repeat")
        for name, check in e.checks.items():
            if not constraints.failing(df, check).isEmpty():
                raise SqlError("constraint", f"check {name} does not hold")

    def insert_rows(self, table: str, rows: list[tuple] | DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Insert many rows at once: Python values, or a DataFrame with the table's columns (one distributed write).

        Constraints are checked on the new rows alone; their keys and unique values are looked up in the table. `batch` is the
        name of a stream and a number: a batch that is not above the table's last one of that stream is in it already.
        """

        def insert(e: Entry) -> int:
            if batch and batch[1] <= e.batches.get(batch[0], -1):
                return 0
            fields = e.schema.fields
            new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([tuple(value(v, f) for v, f in zip(r, fields, strict=True)) for r in rows], e.schema)
            part = self.store.write(table, new.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields)), e)
            written = self.store.frame(replace(e, parts=[part]))
            try:
                self._hold(e, written)
                now = self._frame(table, e)
                for c in [e.key, *e.unique] if e.parts or self.open else []:
                    if not written.select(f"`{c}`").join(now.select(f"`{c}`"), c, "left_semi").isEmpty():
                        raise SqlError("constraint", f"column {c} must not repeat")
            except BaseException:
                self.store.remove(part)
                raise
            e.parts.append(part)
            if batch:
                e.batches[batch[0]] = batch[1]
            if not self.open:
                self._settle(table, e)
            return written.count()

        return self._change(table, "INSERT", insert)

    def optimize(self, table: str) -> None:
        """Rewrite a table compactly, in the order of its organisation and indexes."""
        self._change(table, "OPTIMIZE", lambda e: self._rewrite(table, e))

    def _insert(self, s: t.Insert, tables: dict[str, Entry]) -> Result:
        e = self._entry(s.table, tables)
        fields = e.schema.fields
        if len(s.values) != len(fields):
            raise SqlError("semantic", f"{len(fields)} values expected, found {len(s.values)}")
        row = tuple(value((v.x, v.y) if isinstance(v, t.Point) else v, f) for v, f in zip(s.values, fields, strict=True))
        now = self._frame(s.table, e)
        for c in [e.key, *e.unique]:
            at = [f.name for f in fields].index(c)
            if not now.where(F.col(f"`{c}`") == F.lit(row[at])).isEmpty():
                raise SqlError("constraint", f"{row[at]!r} is in column {c} already")
        one = self.spark.createDataFrame([row], e.schema)
        if e.checks:
            self._hold(e, one, set())
        if self.open:
            self.open.pending.setdefault(s.table, []).append(row)
        else:
            e.parts.append(self.store.write(s.table, one.coalesce(1), e))
        return Result("1 fila insertada", affected_rows=1)

    def _hits(self, s: t.Delete | t.Update, e: Entry) -> tuple[int, list[str], DataFrame, planner.Scope]:
        """How many rows a condition selects, the folders that hold none of them, and the rows of the others with `__hit`."""
        scope = planner.Scope([planner.Table(s.table, self.spark.createDataFrame([], e.schema), e.key)])
        condition = F.coalesce(planner.condition(scope, s.where), F.lit(False))
        inner = [F.col(f"`{f.name}`").alias(i) for _, _, f, i in scope.columns]
        parts: dict[str, int] = {}
        if e.parts:
            stored = self.store.frame(e).select(*inner, F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[0-9a-f]{32})/", 1).alias("__part"))
            parts = {r["__part"]: r["count"] for r in stored.where(condition).groupBy("__part").count().collect()}
        rows = self.open.pending.get(s.table, []) if self.open else []
        fresh = self.spark.createDataFrame(rows, e.schema)
        n = sum(parts.values()) + (fresh.select(*inner).where(condition).count() if rows else 0)
        some = self.store.frame(replace(e, parts=[p for p in e.parts if p in parts]))
        return n, [p for p in e.parts if p not in parts], some.unionByName(fresh).select(*inner).withColumn("__hit", condition), scope

    def _replace(self, name: str, e: Entry, untouched: list[str], df: DataFrame) -> None:
        part = self.store.write(name, df, e)
        if self.open:
            self.open.pending.pop(name, None)
        e.parts = [*untouched, part]

    def _delete(self, s: t.Delete, tables: dict[str, Entry]) -> Result:
        e = self._entry(s.table, tables)
        n, untouched, marked, _ = self._hits(s, e)
        if n:
            self._replace(s.table, e, untouched, marked.where("not __hit").drop("__hit").toDF(*(f.name for f in e.schema.fields)))
        return Result(f"{n} fila(s) eliminada(s)", affected_rows=n)

    def _update(self, s: t.Update, tables: dict[str, Entry]) -> Result:
        e = self._entry(s.table, tables)
        fields = {f.name: f for f in e.schema.fields}
        names = [c for c, _ in s.changes]
        if len(set(names)) != len(names):
            raise SqlError("semantic", "a column is set twice")
        new: dict[str, object] = {}
        for c, v in s.changes:
            if c not in fields:
                raise SqlError("semantic", f"no column {c}")
            new[c] = value((v.x, v.y) if isinstance(v, t.Point) else v, fields[c])
        n, untouched, marked, scope = self._hits(s, e)
        if n:
            self.engine.locks.take(self, s.table, EXCLUSIVE)

            def changed(f, inner):
                if f.name not in new:
                    return F.col(inner).alias(f.name)
                v = spatial.point(*new[f.name]) if f.dataType == POINT else F.lit(new[f.name]).cast(f.dataType)
                return F.when(F.col("__hit"), v).otherwise(F.col(inner)).alias(f.name)

            after = marked.select(*(changed(f, inner) for _, _, f, inner in scope.columns))
            if e.checks or {e.key, *e.unique} & new.keys():
                self._hold(e, self.store.frame(replace(e, parts=untouched)).unionByName(after), set(new))
            self._replace(s.table, e, untouched, after)
        return Result(f"{n} fila(s) actualizada(s)", affected_rows=n)


def _scans(node: explain.Node) -> list[explain.Node]:
    return [node] if not node.below else [x for b in node.below for x in _scans(b)]
