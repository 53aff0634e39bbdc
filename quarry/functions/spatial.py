"""Points, distances, polygons and rectangles as Catalyst expressions.

A point is struct<x, y>: x is the longitude, y the latitude. Filters also state the rectangle that they imply, which reaches the
Parquet scan as a plain comparison of x and y.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres.
EARTH = 6_371_000.0

EUCLIDEAN, GEODESIC = "euclidean", "geodesic"


def point(x: object, y: object) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def _xy(p: Column | tuple[float, float]) -> tuple[Column, Column]:
    if isinstance(p, Column):
        return p["x"], p["y"]
    return F.lit(float(p[0])), F.lit(float(p[1]))


def euclidean(a: Column | tuple, b: Column | tuple) -> Column:
    """Planar distance in the points' own unit."""
    (ax, ay), (bx, by) = _xy(a), _xy(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def on_earth(p: Column | tuple) -> Column:
    x, y = _xy(p)
    return x.between(-180.0, 180.0) & y.between(-90.0, 90.0)


def geodesic(a: Column | tuple, b: Column | tuple, strict: bool = True) -> Column:
    """Haversine distance in metres. Coordinates out of range raise an error, or give null if strict is False."""
    (ax, ay), (bx, by) = _xy(a), _xy(b)
    p, q = F.radians(ay), F.radians(by)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(bx - ax) / 2), 2)
    d = F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    other = F.raise_error(F.lit("a longitude must lie in [-180, 180] and a latitude in [-90, 90]")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(on_earth(a) & on_earth(b), d).otherwise(other)


def distance(metric: str, a: Column | tuple, b: Column | tuple, strict: bool = True) -> Column:
    return euclidean(a, b) if metric == EUCLIDEAN else geodesic(a, b, strict)


def bounds(metric: str, centre: tuple[float, float], radius: float) -> tuple[float | None, float, float | None, float] | None:
    """x from, y from, x to, y to of a rectangle that holds the circle; None for x where the circle reaches a pole or wraps."""
    x, y = centre
    if radius < 0 or not math.isfinite(radius):
        return None
    if metric == EUCLIDEAN:
        return x - radius, y - radius, x + radius, y + radius
    wide = math.degrees(radius / EARTH) * (1 + 1e-9) + 1e-9
    low, high = y - wide, y + wide
    if low <= -90 or high >= 90:
        return None, low, None, high
    ratio = math.sin(math.radians(wide)) / math.cos(math.radians(y))
    if ratio >= 1:
        return None, low, None, high
    across = math.degrees(math.asin(ratio)) * (1 + 1e-9) + 1e-9
    if x - across <= -180 or x + across >= 180:
        return None, low, None, high
    return x - across, low, x + across, high


def in_rectangle(p: Column, x0: float | None, y0: float, x1: float | None, y1: float) -> Column:
    """Whether a point lies in a closed rectangle; an open side is None."""
    inside = (p["y"] >= F.lit(float(y0))) & (p["y"] <= F.lit(float(y1)))
    return inside if x0 is None else (p["x"] >= F.lit(float(x0))) & (p["x"] <= F.lit(float(x1))) & inside


def radius(metric: str, p: Column, centre: tuple[float, float], r: float, inclusive: bool = True, strict: bool = False) -> Column:
    """Whether a point lies within r of the centre: the exact distance, and the rectangle that it implies.

    With strict, coordinates out of range raise an error; so such rows pass the rectangle.
    """
    d = distance(metric, p, centre, strict)
    near = d <= F.lit(float(r)) if inclusive else d < F.lit(float(r))
    box = bounds(metric, centre, r)
    if box is None:
        return near
    inside = in_rectangle(p, *box)
    return (inside | ~on_earth(p) if strict and metric == GEODESIC else inside) & near


def in_polygon(p: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the closed ring: left and lower borders are inside, right and upper ones are not."""
    inside = F.lit(False)
    x, y = p["x"], p["y"]
    for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
        if yi == yj:
            continue  # a horizontal edge is never crossed
        crosses = (F.lit(yi) > y) != (F.lit(yj) > y)
        at = F.lit(float(xj - xi)) * (y - F.lit(yi)) / F.lit(float(yj - yi)) + F.lit(xi)
        inside = inside != (crosses & (x < at))
    xs, ys = [v[0] for v in vertices], [v[1] for v in vertices]
    return in_rectangle(p, min(xs), min(ys), max(xs), max(ys)) & inside


def rectangle(p: Column) -> list[Column]:
    """Aggregates of the smallest rectangle that holds a group's points."""
    return [F.min(p["x"]).alias("x_min"), F.min(p["y"]).alias("y_min"), F.max(p["x"]).alias("x_max"), F.max(p["y"]).alias("y_max")]


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def union(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """The smallest rectangle (x0, y0, x1, y1) that holds two."""
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def enlargement(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """How much area a rectangle gains so that it also holds another."""
    return area(*union(a, b)) - area(*a)


def intersects(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two closed rectangles share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def contains(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether a closed rectangle holds all of another."""
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def mindist(p: Column, a: Sequence[Column]) -> Column:
    """The planar distance from a point to the nearest one of a rectangle; 0 inside."""
    dx = F.greatest(a[0] - p["x"], F.lit(0.0), p["x"] - a[2])
    dy = F.greatest(a[1] - p["y"], F.lit(0.0), p["y"] - a[3])
    return F.sqrt(dx * dx + dy * dy)


def cell(p: Column, size: float) -> Column:
    """A grid cell's number along a Z-shaped curve of 16 bits each way, to sort points by."""
    part = lambda c: F.floor(c / F.lit(float(size))).cast("long").bitwiseAND(0xFFFF)

    def spread(c: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    return spread(part(p["x"])).bitwiseOR(F.shiftleft(spread(part(p["y"])), 1))


LONGITUDES, LATITUDES = ("longitude", "lon", "lng", "x"), ("latitude", "lat", "y")


def points_of(df: DataFrame) -> DataFrame:
    """x, y of a table's first point column, else of columns named like a longitude and a latitude."""
    from quarry.functions.types import POINT

    for f in df.schema.fields:
        if f.dataType == POINT:
            return df.select(F.col(f"`{f.name}`.x").alias("x"), F.col(f"`{f.name}`.y").alias("y"))
    low = {c.lower(): c for c in df.columns}
    x, y = next((low[n] for n in LONGITUDES if n in low), None), next((low[n] for n in LATITUDES if n in low), None)
    if x is None or y is None:
        raise ValueError("the table has no points")
    return df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
