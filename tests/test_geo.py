import math
import random

from pyspark.sql import functions as F

from stopgrid.functions import geo
from stopgrid.operators.graph import components
from stopgrid.operators.spatial import clipped_cells, contains_join, knn, line_join, subdivide, within_join


def test_geodesic_published_values():
    assert abs(float(geo.geodesic_np([0.0], [0.0], [1.0], [0.0])[0]) - 111319.491) < 0.01
    assert abs(float(geo.geodesic_np([0.0], [0.0], [0.0], [1.0])[0]) - 110574.389) < 0.01
    assert float(geo.geodesic_np([5.0], [5.0], [5.0], [5.0])[0]) == 0


def points(spark, n, seed, key):
    rng = random.Random(seed)
    rows = [(i, 2 + rng.random() * 0.05, 48 + rng.random() * 0.05) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} int, lon double, lat double")


def far(a, b):
    h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.MEAN_RADIUS * math.asin(math.sqrt(h))


def test_within_and_knn(spark):
    a, da = points(spark, 60, 1, "a")
    b, db = points(spark, 60, 2, "b")
    got = {(r["a"], r["b_r"]) for r in within_join(da, db, 500).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if far(x, y) <= 500}
    got = {(r["a"], r["b_r"]) for r in knn(da, db, "a", 2, 0.03).collect()}
    want = set()
    for x in a:
        near = sorted((math.hypot(x[1] - y[1], x[2] - y[2]), y[0]) for y in b if abs(x[1] - y[1]) <= 0.03 and abs(x[2] - y[2]) <= 0.03)
        want |= {(x[0], k) for _, k in near[:2]}
    assert got == want


def test_polygons_and_lines(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 2.5, 0.5), (4, 0.25, 0.25)], "id int, lon double, lat double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    hole = [(0.2, 0.2), (0.3, 0.2), (0.3, 0.3), (0.2, 0.3), (0.2, 0.2)]
    poly = spark.createDataFrame([("sq", [ring, hole])], f"name string, rings array<array<{geo.POINT}>>")
    assert [r["id"] for r in contains_join(p, poly).orderBy("id").collect()] == [1]
    assert [r["id"] for r in contains_join(p, poly, border=True).orderBy("id").collect()] == [1, 2]
    assert abs(poly.select(geo.area(F.col("rings"))).first()[0] - 0.99) < 1e-12
    line = spark.createDataFrame([(7, [(0.0, 0.0), (0.0, 1.0)])], f"way_id int, path array<{geo.POINT}>")
    near = spark.createDataFrame([(1, 0.0005, 0.5), (2, 0.01, 0.5)], "id int, lon double, lat double")
    rows = line_join(near, line, 100).collect()
    assert [(r["id"], round(r["near"]["lat"], 6)) for r in rows] == [(1, 0.5)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in nodes}


def star(n, r, x=2.0, y=48.0):
    ring = [(x + (r if i % 2 else r * 0.7) * math.cos(2 * math.pi * i / n), y + (r if i % 2 else r * 0.7) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


def shoelace(rings):
    each = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2 for r in rings]
    return each[0] - sum(each[1:])


def test_cut_polygons(spark):
    """Outlines of many points, with holes: pieces keep the area, and points are found as in the whole."""
    shapes = {1: [star(2000, 1.0), star(600, 0.3)], 2: [star(40, 0.5)], 3: [star(900, 0.2, 2.3, 48.4), star(300, 0.05, 2.3, 48.4)]}
    poly = spark.createDataFrame(list(shapes.items()), "pid int, rings array<array<struct<lon:double,lat:double>>>")
    pieces = subdivide(poly).select("pid", geo.area(F.col("rings")).alias("a"), geo.n_points(F.col("rings")).alias("n")).collect()
    assert max(p["n"] for p in pieces) <= 256 and len(pieces) > 12
    for pid, rings in shapes.items():
        assert abs(sum(p["a"] for p in pieces if p["pid"] == pid) - shoelace(rings)) < 1e-9
    rng = random.Random(9)
    at = [(i, 2 + rng.uniform(-1.1, 1.1), 48 + rng.uniform(-1.1, 1.1)) for i in range(400)] + [(400 + i, 1.0 + 0.25 * i, 47.75) for i in range(9)]
    points = spark.createDataFrame(at, "id int, lon double, lat double")
    inside = lambda ring, x, y: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1
    want = {(i, pid) for i, x, y in at for pid, rings in shapes.items() if sum(inside(r, x, y) for r in rings) % 2 == 1}
    got = [(r["id"], r["pid"]) for r in contains_join(points, poly).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    longest = clipped_cells(poly.where("pid = 1"), 0.25).agg(F.max(geo.n_points(F.col("rings")))).first()[0]
    assert longest < 700
