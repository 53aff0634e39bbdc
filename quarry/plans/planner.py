"""From a SELECT to a DataFrame: names and types are checked first, so errors do not depend on rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import SqlError
from quarry.functions import spatial
from quarry.functions.types import POINT, comparable
from quarry.plans import tree as t


@dataclass
class Table:
    """What the planner knows of a table."""

    name: str
    frame: DataFrame
    key: str | None = None
    ordered: bool = False  # its rows come in the order of its key
    by: str | None = None  # the column that its files are sorted by
    in_order: Callable[[bool], DataFrame | None] = lambda descending: None  # its rows by that column, without an exchange

    @property
    def fields(self) -> list[T.StructField]:
        return self.frame.schema.fields


def semantic(message: str, name: t.Name | None = None) -> SqlError:
    return SqlError("semantic", message, *((name.line, name.at) if name else ()))


class Scope:
    """The columns that a statement sees. Inside, column i of table k is called c<k>_<i>, so equal names do not clash."""

    def __init__(self, tables: list[Table]):
        self.tables = tables
        self.columns = [(k, table.name, f, f"c{k}_{i}") for k, table in enumerate(tables) for i, f in enumerate(table.fields)]

    def frame(self, k: int, frame: DataFrame | None = None) -> DataFrame:
        return (self.tables[k].frame if frame is None else frame).select(*(F.col(f"`{f.name}`").alias(inner) for j, _, f, inner in self.columns if j == k))

    def find(self, name: t.Name, only: int | None = None) -> tuple[T.StructField, str]:
        if name.table is not None and name.table not in [x.name for x in self.tables]:
            raise semantic(f"table {name.table} is not in this statement", name)
        found = [(f, inner) for k, table, f, inner in self.columns if f.name == name.column and name.table in (None, table) and only in (None, k)]
        if not found:
            raise semantic(f"no column {name}", name)
        if len(found) > 1:
            raise semantic(f"column {name} is ambiguous", name)
        return found[0]

    def column(self, name: t.Name) -> Column:
        return F.col(self.find(name)[1])

    def key(self, k: int) -> str | None:
        return next((inner for j, _, f, inner in self.columns if j == k and f.name == self.tables[k].key), None)


def point_of(scope: Scope, x: t.Name | t.Point) -> Column | tuple[float, float]:
    if isinstance(x, t.Point):
        return (x.x, x.y)
    f, inner = scope.find(x)
    if f.dataType != POINT:
        raise semantic(f"column {x} is no POINT", x)
    return F.col(inner)


def distance(scope: Scope, d: t.Distance) -> Column:
    for p in (d.left, d.right):
        if d.metric == spatial.GEODESIC and isinstance(p, t.Point) and not (-180 <= p.x <= 180 and -90 <= p.y <= 90):
            raise semantic(f"{p} lies outside of longitudes and latitudes")
    return spatial.distance(d.metric, point_of(scope, d.left), point_of(scope, d.right))


OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def literal(f: T.StructField, v: object, name: t.Name) -> Column:
    if isinstance(v, t.Point):
        v = (v.x, v.y)
    if not comparable(f, v):
        raise semantic(f"column {name} of type {f.dataType.simpleString()} cannot be compared with {v!r}", name)
    if isinstance(v, tuple):
        return spatial.point(*v)
    if isinstance(f.dataType, T.DateType) and isinstance(v, int):
        return F.date_add(F.lit("1970-01-01").cast("date"), F.lit(v))
    if isinstance(v, str) and not isinstance(f.dataType, T.StringType):
        return F.lit(v).cast(f.dataType)
    if isinstance(v, float):
        return F.lit(v).cast("double")
    return F.lit(v)


def condition(scope: Scope, c: object) -> Column:
    """A predicate; distances to a fixed point within a radius, and polygons, also state the rectangle that they imply."""
    if isinstance(c, (t.All, t.Any)):
        out = None
        for part in c.parts:
            p = condition(scope, part)
            out = p if out is None else out & p if isinstance(c, t.All) else out | p
        return out
    if isinstance(c, t.Within):
        p = point_of(scope, c.left)
        return spatial.in_polygon(p, [(v.x, v.y) for v in c.vertices])
    if isinstance(c, t.Between):
        f, inner = scope.find(c.left)
        return F.col(inner).between(literal(f, c.low, c.left), literal(f, c.high, c.left))
    if isinstance(c.left, t.Distance):
        if isinstance(c.value, bool) or not isinstance(c.value, (int, float)):
            raise semantic(f"a distance cannot be compared with {c.value!r}")
        d = c.left
        if c.op in ("<", "<=") and isinstance(d.left, t.Point) != isinstance(d.right, t.Point):
            centre, p = (d.left, d.right) if isinstance(d.left, t.Point) else (d.right, d.left)
            distance(scope, d)  # its checks
            return spatial.radius(d.metric, point_of(scope, p), (centre.x, centre.y), c.value, c.op == "<=", strict=True)
        return OPERATORS[c.op](distance(scope, d), F.lit(float(c.value)))
    f, inner = scope.find(c.left)
    if f.dataType == POINT and c.op not in ("=", "!="):
        raise semantic(f"points have no order: {c}", c.left)
    return OPERATORS[c.op](F.col(inner), literal(f, c.value, c.left))


def aggregate(scope: Scope, a: t.Aggregate) -> Column:
    if a.argument is None:
        return F.count(F.lit(1))
    f, inner = scope.find(a.argument)
    if a.function in ("sum", "avg") and not isinstance(f.dataType, T.NumericType):
        raise semantic(f"{a.function} needs numbers, {a.argument} is {f.dataType.simpleString()}", a.argument)
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.function](F.col(inner))


def select(s: t.Select, tables: dict[str, Table], standard_empty: bool = False) -> tuple[DataFrame, list[str]]:
    """The rows of a SELECT and the names of its columns, which may repeat.

    Rows that ORDER BY leaves tied come by the tables' keys. An aggregate over no rows without GROUP BY has no row, or the one
    that standard SQL gives if `standard_empty`.
    """
    for name in [s.table, *([s.join[0]] if s.join else [])]:
        if name not in tables:
            raise semantic(f"no table {name}")
    scope = Scope([tables[s.table], *([tables[s.join[0]]] if s.join else [])])
    df, sorted_already = scope.frame(0), False
    first = scope.tables[0]
    plain = not s.join and s.group is None and not any(isinstance(i, t.Aggregate) for i in s.items or ())
    if plain and first.by and (isinstance(s.order, t.Name) and scope.find(s.order)[0].name == first.by or s.order is None and first.ordered):
        if (sorted_rows := first.in_order(bool(s.order and s.descending))) is not None:
            df, sorted_already = scope.frame(0, sorted_rows), True
    if s.join:
        other, a, b = s.join
        if other == s.table and (s.items is not None or s.where or s.group or s.order):
            raise semantic("a table joined with itself has only *, as its columns share their names")
        if (a.table == other and other != s.table) or (b.table == s.table and other != s.table):
            raise semantic(f"ON names the column of {s.table} first", a)
        (fa, ia), (fb, ib) = scope.find(a, 0), scope.find(b, 1)
        if POINT in (fa.dataType, fb.dataType):
            raise semantic("a POINT is no join key", a)
        if isinstance(fa.dataType, T.NumericType) != isinstance(fb.dataType, T.NumericType) or (not isinstance(fa.dataType, T.NumericType) and fa.dataType != fb.dataType):
            raise semantic(f"{a} and {b} have types that cannot be equal", a)
        df = df.join(scope.frame(1), F.col(ia) == F.col(ib))
    if s.where is not None:
        df = df.where(condition(scope, s.where))
    aggregates = [i for i in s.items or () if isinstance(i, t.Aggregate)]
    if s.group is not None or aggregates:
        return _grouped(s, scope, df, standard_empty)
    if sorted_already:
        pass
    elif s.order is not None:
        by = distance(scope, s.order) if isinstance(s.order, t.Distance) else scope.column(s.order)
        ties = [F.col(k) for k in (scope.key(i) for i in range(len(scope.tables))) if k]
        df = df.orderBy(by.desc() if s.descending else by.asc(), *ties)
    elif not s.join and scope.tables[0].ordered and scope.key(0):
        df = df.orderBy(scope.key(0))
    if s.limit is not None:
        df = df.limit(s.limit)
    chosen = [(f.name, inner) for _, _, f, inner in scope.columns] if s.items is None else [(i.column, scope.find(i)[1]) for i in s.items]
    return _named(df, chosen)


def _named(df: DataFrame, chosen: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    names = [n for n, _ in chosen]
    return df.select(*(F.col(inner) for _, inner in chosen)).toDF(*names), names


def _grouped(s: t.Select, scope: Scope, df: DataFrame, standard_empty: bool) -> tuple[DataFrame, list[str]]:
    if s.items is None:
        raise semantic("* cannot be grouped")
    group = scope.find(s.group) if s.group is not None else None
    for i in s.items:
        if isinstance(i, t.Name) and (group is None or scope.find(i)[1] != group[1]):
            raise semantic(f"column {i} is neither grouped nor aggregated", i)
    if isinstance(s.order, t.Distance) or (s.order is not None and (group is None or scope.find(s.order)[1] != group[1] or not any(isinstance(i, t.Name) for i in s.items))):
        raise semantic("groups are ordered by the grouped column, if it is selected")
    distinct = list(dict.fromkeys(str(i) for i in s.items if isinstance(i, t.Aggregate)))
    first = {str(i): i for i in s.items if isinstance(i, t.Aggregate)}
    columns = [aggregate(scope, first[d]).alias(f"a{k}") for k, d in enumerate(distinct)]
    if group is not None:
        df = df.groupBy(group[1]).agg(*columns) if columns else df.select(group[1]).distinct()
    else:
        df = df.agg(*columns, F.count(F.lit(1)).alias("__rows"))
        df = df if standard_empty else df.where(F.col("__rows") > 0)
    if s.order is not None:
        df = df.orderBy(F.desc(group[1]) if s.descending else F.asc(group[1]))
    if s.limit is not None:
        df = df.limit(s.limit)
    return _named(df, [(str(i), f"a{distinct.index(str(i))}") if isinstance(i, t.Aggregate) else (i.column, group[1]) for i in s.items])
