"""Queries that must read all rows, by brute force on small tables."""

import random

from stopgrid import queries_relational as Q
from stopgrid import queries_steps as T


def test_components_of_all_orders(spark, tmp_path):
    rng = random.Random(5)
    rows = [(o, rng.randrange(6) + 6 * rng.randrange(2) + 20 * (o % 9)) for o in range(60) for _ in range(rng.choice([1, 2, 3]))]
    rows += [(97, 1000), (97, 1001), (98, 1001), (98, 1002), (99, 1003), (99, 1003), (None, 1004), (None, 1005)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = {(a, b) for o, a in rows for p, b in rows if o is not None and o == p and a != b}
    root = {a: a for a, _ in links}
    for _ in root:
        for a, b in links:
            root[a] = min(root[a], root[b])
    for name in ("rec_transitive_closure", "rec_connected_components"):
        got = Q.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == len(root) and {r["node"]: r["group_id"] for r in got} == root


def test_all_orders_are_relations(spark, tmp_path):
    rng = random.Random(6)
    orders = [(13 * k, "1-URGENT") for k in range(1, 60)]
    items = [(13 * k, rng.randrange(1, 25), 1, n, "N", 1.0, 1.0) for k in range(1, 59) for n in range(1, rng.choice([2, 3]))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, 1, "BUILDING") for c in range(1, 60)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = T.QUERIES["st_rel_members"](spark, str(tmp_path)).collect()
    assert sorted((r["relation_id"], r["osm_id"]) for r in got) == sorted((i[0], i[1]) for i in items)
    primary = {c for c in range(1, 60) if c % 12 in (0, 1, 2, 3, 4, 8, 10) or c % 60 == 9}
    areas = {k: {i[1] for i in items if i[0] == k} for k in range(65, 13 * 59, 65)}
    root = {k: k for k in areas}
    for _ in areas:
        for a in areas:
            for b in areas:
                if areas[a] & areas[b] & primary:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["relation_id"]: r["group_id"] for r in T.QUERIES["st_area_group"](spark, str(tmp_path)).collect()} == root
    assert set(root.values()) != set(root)


def test_sorts_give_all_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, rng.choice(["F", "O", "P", None]), rng.choice(["1-URGENT", "5-LOW", None]), rng.choice([None, 1.5, 2.5, 9.0])) for k in range(150)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    first = {"F": 0, "O": 1, "P": 1, None: 2}
    want = sorted(rows, key=lambda r: (first[r[1]], r[2] != "1-URGENT", r[3] is None, -(r[3] or 0), r[0]))
    assert [r[0] for r in Q.QUERIES["sort_multi_key"](spark, str(tmp_path)).collect()] == [r[0] for r in want]
    nulls = sorted(rows, key=lambda r: ({"P": 0, None: 0, "O": 1, "F": 2}[r[1]], r[0]))
    got = Q.QUERIES["sort_nulls_explicit"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(r[0], None if r[1] == "P" else r[1]) for r in nulls]


def test_distances_to_all_polygons(spark, tmp_path):
    import math

    from stopgrid import queries_functions as G

    for t, columns in (("customer", "c_custkey long, c_nationkey int, c_mktsegment string"), ("nation", "n_nationkey int, n_name string, n_regionkey int")):
        rows = [(c, 1, "BUILDING") for c in range(1, 80)] if t == "customer" else [(n, f"N{n}", n % 5) for n in range(25)]
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{t}.parquet")
    boxes = {r["n_nationkey"]: [(p["lon"], p["lat"]) for p in r["rings"][0]] for r in G.rectangles(spark, str(tmp_path)).collect()}
    want = set()
    for s in G.stops(spark, str(tmp_path)).collect():
        for n, ring in boxes.items():
            (x0, y0), (x1, y1) = map(min, zip(*ring, strict=True)), map(max, zip(*ring, strict=True))
            off = math.hypot(max(x0 - s["lon"], 0, s["lon"] - x1), max(y0 - s["lat"], 0, s["lat"] - y1))
            if off <= 500 / (111320 * math.cos(math.radians(s["lat"]))):
                want.add((s["c_custkey"], n))
    got = [tuple(r) for r in G.QUERIES["join_polygon_distance"](spark, str(tmp_path)).collect()]
    assert len({n for _, n in want}) > 5 and len(got) == len(set(got)) and set(got) == want
