"""What a statement says."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A column, perhaps with its table."""

    column: str
    table: str | None = None
    line: int = field(default=0, compare=False)
    at: int = field(default=0, compare=False)

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Point:
    x: float
    y: float

    def __str__(self) -> str:
        return f"POINT({self.x}, {self.y})"


@dataclass(frozen=True)
class Distance:
    metric: str
    left: Name | Point
    right: Name | Point

    def __str__(self) -> str:
        return f"{self.metric}({self.left}, {self.right})"


@dataclass(frozen=True)
class Compare:
    left: Name | Distance
    op: str
    value: object

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.value!r}"


@dataclass(frozen=True)
class Between:
    left: Name
    low: object
    high: object

    def __str__(self) -> str:
        return f"{self.left} BETWEEN {self.low!r} AND {self.high!r}"


@dataclass(frozen=True)
class Within:
    left: Name
    vertices: tuple[Point, ...]

    def __str__(self) -> str:
        return f"within({self.left}, POLYGON of {len(self.vertices)})"


@dataclass(frozen=True)
class All:
    """Conditions that must all hold."""

    parts: tuple

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Any:
    """Conditions of which one must hold."""

    parts: tuple

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Name | None  # None: *

    def __str__(self) -> str:
        inner = self.argument.column if self.argument else "*"
        return f"{self.function}({inner})" if self.function == "count" else f"{self.function}_agg({inner})"


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None: *
    table: str
    join: tuple[str, Name, Name] | None = None
    where: object = None
    group: Name | None = None
    order: Name | Distance | None = None
    descending: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str, bool], ...]  # name, type, whether it is the primary key
    organisation: str


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str
    kind: str
    clustered: bool


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple


@dataclass(frozen=True)
class Delete:
    table: str
    where: object


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, object], ...]
    where: object


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class End:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


@dataclass(frozen=True)
class Explain:
    statement: object
    analyze: bool


def dump(x: object, depth: int = 0) -> str:
    """A statement's tree, one line for each part."""
    pad = "  " * depth
    if hasattr(x, "__dataclass_fields__"):
        lines = [pad + type(x).__name__]
        for name in x.__dataclass_fields__:
            v = getattr(x, name)
            if name in ("line", "at") or v is None:
                continue
            deep = hasattr(v, "__dataclass_fields__") or isinstance(v, tuple)
            lines.append(f"{pad}  {name}:" + ("" if deep else f" {v!r}"))
            if deep:
                lines.append(dump(v, depth + 2))
        return "\n".join(lines)
    if isinstance(x, tuple):
        return "\n".join(dump(v, depth) for v in x)
    return pad + repr(x)
