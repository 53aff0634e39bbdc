"""Type names, literals, and what a column of each type accepts."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import types as T

from quarry.errors import SqlError

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_TIMETZ = T.StructType([T.StructField("micros", T.LongType()), T.StructField("zone", T.IntegerType())])
_INTERVAL = T.StructType([T.StructField("micros", T.LongType()), T.StructField("days", T.IntegerType()), T.StructField("months", T.IntegerType())])

#: Every type name that storage knows (fixed values).
NAMES: dict[str, T.DataType] = {
    **dict.fromkeys(("int", "integer", "int4"), T.IntegerType()),
    **dict.fromkeys(("smallint", "int2"), T.ShortType()),
    **dict.fromkeys(("bigint", "int8", "oid", "xid", "cid", "time", "money"), T.LongType()),
    **dict.fromkeys(("float", "real", "float4"), T.FloatType()),
    **dict.fromkeys(("double precision", "float8"), T.DoubleType()),
    **dict.fromkeys(("bool", "boolean"), T.BooleanType()),
    **dict.fromkeys(("text", "string", "str", "json", "jsonb", "xml", "varbit", "bytea", "uuid", "name"), T.StringType()),
    "char": T.ByteType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestampz": T.TimestampType(),
    "timetz": _TIMETZ,
    "interval": _INTERVAL,
    "point": POINT,
}
#: Types that SQL can declare.
SQL_TYPES = ("INT", "FLOAT", "BOOL", "DATE", "VARCHAR", "POINT")
RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def resolve(name: str) -> tuple[T.DataType, int | None]:
    """The Spark type of a type name and its length, if it has one: varchar(n), char(n), bit(n)."""
    low = " ".join(name.strip().lower().split())
    if m := re.fullmatch(r"(varchar|char|bit)\s*\(\s*(-?\d+)\s*\)", low):
        if int(m[2]) <= 0:
            raise TypeError(f"the length of {name} must be positive")
        return (T.BinaryType() if m[1] == "bit" else T.StringType()), int(m[2])
    if low not in NAMES:
        raise TypeError(f"unknown type {name}")
    return NAMES[low], None


def field(name: str, type_name: str) -> T.StructField:
    """A column whose declared type, and the length in bytes of its strings, are in its metadata."""
    kind, length = resolve(type_name)
    return T.StructField(name, kind, True, {"type": type_name.lower()} | ({"length": length} if length else {}))


def cut(text: str, length: int | None) -> str:
    """At most so many bytes of UTF-8, cut between characters, without trailing NULs."""
    if length is not None:
        text = text.encode()[:length].decode("utf-8", "ignore")
    return text.rstrip("\0")


def value(v: object, f: T.StructField, strict: bool = False) -> object:
    """A literal as the column stores it; raises where the column cannot hold it."""
    t = f.dataType

    def wrong() -> SqlError:
        return SqlError("semantic", f"column {f.name} of type {f.metadata.get('type', t.simpleString())} cannot hold {v!r}")

    if isinstance(t, T.StringType):
        if not isinstance(v, str):
            raise wrong()
        short = cut(v, f.metadata.get("length"))
        if strict and short != v.rstrip("\0"):
            raise SqlError("constraint", f"{v!r} is longer than column {f.name}")
        return short
    if isinstance(t, T.BooleanType):
        if not isinstance(v, bool):
            raise wrong()
        return v
    if isinstance(t, T.DateType):
        if isinstance(v, str):
            try:
                return date.fromisoformat(v)
            except ValueError:
                raise wrong() from None
        if isinstance(v, bool) or not isinstance(v, int):
            raise wrong()
        return date(1970, 1, 1) + timedelta(days=v)
    if type(t) in RANGES:
        if isinstance(v, bool):
            v = int(v)
        if not isinstance(v, int) or not -(1 << RANGES[type(t)] - 1) <= v < 1 << RANGES[type(t)] - 1:
            raise wrong()
        return v
    if isinstance(t, (T.FloatType, T.DoubleType)):
        if not isinstance(v, (int, float)):
            raise wrong()
        return float(v)
    if t == POINT:
        if not (isinstance(v, tuple) and len(v) == 2):
            raise wrong()
        return (float(v[0]), float(v[1]))
    raise wrong()


def comparable(f: T.StructField, v: object) -> bool:
    """Whether a literal may be compared with a column."""
    t = f.dataType
    if isinstance(v, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(t, T.NumericType) or (isinstance(t, T.DateType) and isinstance(v, int))
    if isinstance(v, str):
        return isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return t == POINT
