"""Plans as trees of text: one column, QUERY PLAN."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.functions import spatial
from quarry.plans import tree as t

#: Selectivity of an equality, a range, a bounded range, a polygon; costs of a page, a row, a comparison.
EQUAL, RANGE, BOUNDED, POLYGON = 0.005, 0.3333, 0.005, 0.02
PAGE, ROW, COMPARISON = 1.0, 0.01, 0.0025


@dataclass
class Node:
    label: str
    rows: float
    cost: float
    width: int
    notes: list[str] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)
    actual: str = ""


def selectivity(c: object) -> float:
    if isinstance(c, t.All):
        out = 1.0
        for p in c.parts:
            out *= selectivity(p)
        return out
    if isinstance(c, t.Any):
        return min(1.0, sum(map(selectivity, c.parts)))
    if isinstance(c, t.Within):
        return POLYGON
    if isinstance(c, t.Between):
        return BOUNDED
    return EQUAL if c.op == "=" else 1 - EQUAL if c.op == "!=" else RANGE


def access(c: object, indexes: dict[str, list[str]], key: str | None = None) -> str | None:
    """The index that a condition's first conjunct could use: its name; the layout that it stands for serves the scan."""
    parts = c.parts if isinstance(c, t.All) else [c]
    for p in parts:
        if isinstance(p, t.Within) or (isinstance(p, t.Compare) and isinstance(p.left, t.Distance)):
            names = [x for x in ((p.left,) if isinstance(p, t.Within) else (p.left.left, p.left.right)) if isinstance(x, t.Name)]
            kinds = ("rtree",)
        elif isinstance(p, (t.Compare, t.Between)):
            names, kinds = [p.left], ("clustered", "unclustered", "bitmap") + (("hash",) if isinstance(p, t.Compare) and p.op == "=" else ())
            if isinstance(p, t.Compare) and p.op == "!=":
                continue
        else:
            continue
        for n in names:
            for index in indexes.get(n.column, []):
                if index.rsplit("_", 1)[-1] in kinds:
                    return index
    return None


def build(s: object, info) -> Node:
    """The plan of a statement; info(table) gives (rows, width, {column: indexes})."""
    if not isinstance(s, t.Select):
        name = type(s).__name__
        node = Node(f"{name} on {s.table}" if hasattr(s, "table") else name, 1, PAGE, 0)
        if isinstance(s, (t.Delete, t.Update)):
            node.below.append(_scan(s.table, s.where, info))
        return node
    knn = s.join is None and s.limit is not None and isinstance(s.order, t.Distance) and not s.descending and isinstance(s.order.left, t.Point) != isinstance(s.order.right, t.Point)
    if s.join:
        a, b = _scan(s.table, None, info), _scan(s.join[0], None, info)
        rows = max(a.rows, b.rows)
        node = Node("Hash Join", rows, a.cost + b.cost + ROW * rows, a.width + b.width, [f"Hash Cond: ({s.join[1]} = {s.join[2]})"], [a, b])
        if s.where is not None:
            node.notes.append(f"Filter: {s.where}")
            node.rows = max(1.0, rows * selectivity(s.where))
    else:
        node = _scan(s.table, s.where, info)
    if s.group is not None or any(isinstance(i, t.Aggregate) for i in s.items or ()):
        rows = max(1.0, node.rows * 0.1) if s.group is not None else 1.0
        node = Node("HashAggregate" if s.group is not None else "Aggregate", rows, node.cost + ROW * node.rows, 16, [f"Group Key: {s.group}"] if s.group else [], [node])
    if s.order is not None:
        label = "Top-N Sort (nearest neighbours)" if knn else "Top-N Sort" if s.limit is not None else "Sort"
        node = Node(label, node.rows, node.cost + COMPARISON * node.rows * max(1.0, node.rows).bit_length() if isinstance(node.rows, int) else node.cost + COMPARISON * node.rows * 10, node.width, [f"Sort Key: {s.order}{' DESC' if s.descending else ''}"], [node])
    if s.limit is not None:
        node = Node("Limit", min(node.rows, s.limit), node.cost, node.width, [], [node])
    return node


def _scan(table: str, where: object, info) -> Node:
    rows, width, indexes = info(table)
    index = access(where, indexes) if where is not None else None
    out = max(1.0, rows * selectivity(where)) if where is not None and rows else float(rows)
    kind = "Seq Scan" if index is None else {"rtree": "RTree Index Scan", "bitmap": "Bitmap Index Scan"}.get(index.rsplit("_", 1)[-1], "Index Scan")
    node = Node(kind + (f" using {index}" if index else "") + f" on {table}", out, PAGE + ROW * rows, width)
    if where is not None:
        node.notes.append(f"Filter: {where}")
        box = _box(where)
        if box:
            node.notes.append(f"Pushed Rectangle: {box}")
    return node


def _box(c: object) -> str:
    for p in c.parts if isinstance(c, t.All) else [c]:
        if isinstance(p, t.Within):
            return f"x {min(v.x for v in p.vertices)}..{max(v.x for v in p.vertices)}, y {min(v.y for v in p.vertices)}..{max(v.y for v in p.vertices)}"
        if isinstance(p, t.Compare) and isinstance(p.left, t.Distance) and p.left.metric == spatial.EUCLIDEAN and p.op in ("<", "<="):
            centre = next((x for x in (p.left.left, p.left.right) if isinstance(x, t.Point)), None)
            if centre and (b := spatial.bounds(p.left.metric, (centre.x, centre.y), float(p.value))):
                return f"x {b[0]}..{b[2]}, y {b[1]}..{b[3]}"
    return ""


def lines(node: Node, depth: int = 0) -> list[str]:
    head = "  " * depth + ("-> " if depth else "") + f"{node.label}  (cost=0.00..{node.cost:.2f} rows={max(0, round(node.rows))} width={node.width})" + node.actual
    out = [head, *("  " * depth + "   " + n for n in node.notes)]
    for b in node.below:
        out += lines(b, depth + 1)
    return out
