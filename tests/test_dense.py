"""Dense tables: joins give what brute force gives, without meeting far more pairs than they keep."""

import math
import random

from pyspark.sql import functions as F

from stopgrid import queries_relational as QR
from stopgrid.operators import graph, spatial


def _points(n, seed, name, wide=0.05, lat=48.8):
    r = random.Random(seed)
    return [(i, r.randrange(3), 2 + r.random() * wide, lat + r.random() * wide) for i in range(n)], f"{name} long, g int, lon double, lat double"


def _metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p[2:]) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def _degrees(a, b):
    return math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)


def _counted(monkeypatch):
    """Rows that spatial.grid_cells makes, by call."""
    made, real = [], spatial.grid_cells

    def cells(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "grid_cells", cells)
    return made


def test_macro_meets_balances_by_cells(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, i % 2, round(r.random() * 4000 - 2000, 2)) for i in range(300)] + [(900, 0, 25.0), (901, 0, 50.0), (902, 0, 0.0), (903, 1, None), (904, 0, -25.0), (905, 0, 75.01)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = QR.prj_macro(spark, str(tmp_path))
    assert "cell" in got._jdf.queryExecution().analyzed().toString()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 25)
    assert sorted(map(tuple, got.collect())) == want


def test_within_join_is_narrow(spark, monkeypatch):
    for lat in (48.8, -60.0, 85.0):  # beyond 78 degrees too
        (a, sa), (b, sb) = _points(300, 1, "a", lat=lat), _points(300, 2, "b", lat=lat)
        da, db = spark.createDataFrame(a, sa), spark.createDataFrame(b, sb)
        want = {(x[0], y[0]) for x in a for y in b if _metres(x, y) <= 300}
        assert {(r["a"], r["b_r"]) for r in spatial.within_join(da, db, 300).collect()} == want
        with monkeypatch.context() as m:
            m.setattr(spatial.geo, "dist_m", lambda *_: F.lit(0.0))
            assert spatial.within_join(da, db, 300).count() < 6 * len(want)


def test_knn_grows_its_boxes(spark, monkeypatch):
    (a, sa), (b, sb) = _points(200, 3, "a"), _points(4000, 4, "b")
    b += [(5000, 0, a[0][2], a[0][3]), (5001, 0, a[0][2], a[0][3])]
    made = _counted(monkeypatch)
    got = {(r["a"], r["b_r"], r["_rank"]) for r in spatial.knn(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb), "a", 3, 0.03, tie=["b_r"]).collect()}
    want = {(x[0], y[0], i + 1) for x in a for i, y in enumerate(sorted((y for y in b if max(abs(x[2] - y[2]), abs(x[3] - y[3])) <= 0.03), key=lambda y: (_degrees(x, y), y[0]))[:3])}
    assert got == want
    assert sum(made) < 200 * 400  # a box of the full reach holds some 2,500 points


def test_mutual_nearest_does_not_meet_all_of_a_group(spark, monkeypatch):
    (a, sa), (b, sb) = _points(600, 5, "a"), _points(600, 6, "b")
    a.append((9000, 7, 2.0, 48.8)), b.append((9001, 7, 2.0001, 48.8))  # a group of one each
    made = _counted(monkeypatch)
    got = {(r["a"], r["b"]) for r in spatial.mutual_nearest(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb), "g", "a", "b", 800, 1.5).collect()}
    want = set()
    for x in a:
        near = sorted((y for y in b if y[1] == x[1]), key=lambda y: (_degrees(x, y), y[0]))
        back = min((z for z in a if z[1] == x[1]), key=lambda z: (_degrees(near[0], z), z[0]))
        d = _metres(x, near[0])
        if back[0] == x[0] and d <= 800 and (len(near) < 2 or _metres(x, near[1]) >= 1.5 * d):
            want.add((x[0], near[0][0]))
    assert got == want and (9000, 9001) in got
    assert made and sum(made) < 600 * 200


def test_nearest_within(spark):
    (a, sa), (b, sb) = _points(150, 8, "a"), _points(400, 9, "b")
    b += [(5000, y[1], y[2], y[3]) for y in b[:1]]  # a tie
    got = {(r["a"], r["b_r"]) for r in spatial.nearest_within(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb), 400, ["a"], ["b_r"], ["g"]).collect()}
    want = set()
    for x in a:
        near = sorted((_metres(x, y), y[0]) for y in b if y[1] == x[1] and _metres(x, y) <= 400)
        want |= {(x[0], near[0][1])} if near else set()
    assert got == want


def test_components_of_a_shuffled_chain_take_few_rounds(spark):
    ids = list(range(400))
    random.Random(10).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(1000, 1001)], "u long, v long")
    rounds, real = [], graph.written
    out = graph.components(edges, lambda df, name: (rounds.append(name), real(df, name))[1])
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in ids} | {(1000, 1000), (1001, 1000)}
    assert len(rounds) <= 12
