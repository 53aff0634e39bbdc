"""Distances, polygons and rectangles against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import SqlError
from quarry.functions import spatial
from quarry.session import Engine


def haversine(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1.0, math.sqrt(h)))


def inside(p, ring):
    out = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if (yi > p[1]) != (yj > p[1]) and p[0] < (xj - xi) * (p[1] - yi) / (yj - yi) + xi:
            out = not out
    return out


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(7)
    some = [(round(-77.04 + rnd.uniform(-0.3, 0.3), 6), round(-12.05 + rnd.uniform(-0.3, 0.3), 6)) for _ in range(300)]
    some += [(179.9, 0.0), (-179.9, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (10.0, 89.9), (-170.0, 89.9), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(some)], "id int, p struct<x:double,y:double>").cache()
    return some, df


def test_distances(points):
    some, df = points
    for c in ((-77.0428, -12.0464), (0.0, 0.0), (180.0, 0.0), (5.0, 90.0)):
        for r in df.select("p", spatial.euclidean(F.col("p"), c).alias("e"), spatial.geodesic(F.col("p"), c).alias("g")).collect():
            assert abs(r.e - math.dist(r.p, c)) < 1e-9 and abs(r.g - haversine(r.p, c)) < 1e-3
    assert abs(haversine((0, 0), (1, 0)) - 111_195) < 1


def test_the_rectangle_of_a_circle_hides_no_point(points):
    some, df = points
    for metric, radii in ((spatial.EUCLIDEAN, (0, 0.05, 1, 300)), (spatial.GEODESIC, (0, 5_000, 25_000, 1e6, 9e6, 2.1e7))):
        for c in ((-77.0428, -12.0464), (180.0, 0.0), (-179.95, 0.0), (5.0, 89.95), (0.0, 0.0), some[0]):
            for r in radii:
                got = {x.id for x in df.where(spatial.radius(metric, F.col("p"), c, r)).select("id").collect()}
                exact = (lambda p: math.dist(p, c)) if metric == spatial.EUCLIDEAN else (lambda p: haversine(p, c))
                want = {i for i, p in enumerate(some) if exact(p) <= r}
                assert {i for i in got ^ want if abs(exact(some[i]) - r) > 1e-6} == set(), (metric, c, r)


def test_polygons(spark):
    grid = [(x / 2, y / 2) for x in range(-3, 12) for y in range(-3, 12)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(grid)], "id int, p struct<x:double,y:double>")
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (2, 2), (4, 4)], [(1, 0), (3, 5), (0, 2)]]
    for ring in rings:
        got = {r.id for r in df.where(spatial.in_polygon(F.col("p"), ring)).collect()}
        assert got == {i for i, p in enumerate(grid) if inside(p, ring)}, ring


def test_rectangles_and_cells(spark, points):
    some, df = points
    r = df.agg(*spatial.rectangle(F.col("p"))).first()
    assert (r.x_min, r.y_max) == (min(p[0] for p in some), max(p[1] for p in some))
    got = df.where(spatial.in_rectangle(F.col("p"), -1, -1, 1, 1)).count()
    assert got == sum(-1 <= x <= 1 and -1 <= y <= 1 for x, y in some)
    cells = df.select(spatial.cell(F.col("p"), 0.05).alias("c")).distinct().count()
    assert 10 < cells <= len(some)


def test_bounds_reach_the_scan(spark, points, tmp_path):
    _, df = points
    df.write.parquet(f"{tmp_path}/p")
    plan = spark.read.parquet(f"{tmp_path}/p").where(spatial.radius(spatial.EUCLIDEAN, F.col("p"), (0, 0), 2.0))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p.x,-2.0)" in plan and "LessThanOrEqual(p.x,2.0)" in plan


def test_statements_on_points(spark, tmp_path, points):
    some, _ = points
    s = Engine(spark, f"file://{tmp_path}/w").session()
    s.sql("CREATE TABLE shops (id INT PRIMARY KEY, name VARCHAR(20), at POINT) USING HEAP")
    s.insert_rows("shops", [(i, f"s{i % 3}", p) for i, p in enumerate(some)])
    asked = [
        "SELECT id FROM shops WHERE distancia(at, POINT(-77.04, -12.05)) < 0.1",
        "SELECT id FROM shops WHERE distancia_geodesica(POINT(-77.04, -12.05), at) <= 9000 AND name = 's1'",
        "SELECT id FROM shops ORDER BY distancia(at, POINT(-77.04, -12.05)) LIMIT 7",
        "SELECT id FROM shops WHERE name = 's2' ORDER BY distancia_geodesica(at, POINT(-77.04, -12.05)) LIMIT 7",
        "SELECT id FROM shops ORDER BY distancia(at, POINT(0, 0)) DESC LIMIT 3",
        "SELECT id FROM shops WHERE dentro_de(at, POLYGON(POINT(-77.1,-12.1), POINT(-77.0,-12.1), POINT(-77.0,-12.0), POINT(-77.1,-12.0)))",
    ]
    before = [[r[0] for r in s.one(q).rows()] for q in asked]
    c = (-77.04, -12.05)
    assert sorted(before[0]) == [i for i, p in enumerate(some) if math.dist(p, c) < 0.1]
    assert sorted(before[1]) == [i for i, p in enumerate(some) if haversine(p, c) <= 9000 and i % 3 == 1]
    assert before[2] == sorted(range(len(some)), key=lambda i: (math.dist(some[i], c), i))[:7]
    assert before[3] == sorted((i for i in range(len(some)) if i % 3 == 2), key=lambda i: (haversine(some[i], c), i))[:7]
    s.sql("CREATE INDEX ON shops (at) USING RTREE")
    after = [[r[0] for r in s.one(q).rows()] for q in asked]
    assert [sorted(x) for x in after] == [sorted(x) for x in before] and after[2:5] == before[2:5]
    plan = "\n".join(r[0] for r in s.one("EXPLAIN " + asked[2]).rows())
    assert "Sort Key: euclidean(at, POINT(-77.04, -12.05))" in plan and "TakeOrderedAndProject" in plan
    with pytest.raises(SqlError):
        s.sql("SELECT id FROM shops WHERE distancia_geodesica(at, POINT(200, 0)) < 5")
    s.sql("INSERT INTO shops VALUES (9999, 'x', POINT(200, 0))")
    with pytest.raises(Exception, match="longitude"):
        s.one("SELECT id FROM shops WHERE distancia_geodesica(at, POINT(0, 0)) < 5").rows()
