"""What the build reads off relations' own member lists is what the exploded members give, without shuffles."""

from stopgrid.plans import adapters as A
from stopgrid.plans import steps as S

RELS = "relation_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"


def _rels(spark):
    stops, plain = [("N", 1, "stop"), ("N", 2, "platform"), ("W", 3, "stop_exit"), ("N", 1, None)], [("N", 4, None), ("N", 5, "")]
    rows = [(1, {"route": "tram", "ref": "5", "colour": "#1"}, stops), (2, {"route": "ferry"}, plain), (3, {"name": "no route"}, stops), (4, {"route": "train", "ref": "R1"}, plain), (5, {"route": "bus"}, [])]
    return spark.createDataFrame(rows, RELS)


def test_calls_and_lines_without_shuffles(spark):
    rels = _rels(spark)
    members, lines = S.rel_members(rels), S.line_routes(rels)
    calls = S.route_calls(rels)
    assert "Exchange" not in calls._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert sorted(map(tuple, calls.drop("route").collect())) == sorted(map(tuple, S.route_stops(members).collect())) == [(1, 1, "N", 1), (1, 3, "W", 3), (2, 1, "N", 4), (2, 2, "N", 5), (4, 1, "N", 4), (4, 2, "N", 5)]
    want = {(m["relation_id"], x["mode"], x["tags"]["ref"], x["tags"].get("colour"), m["osm_type"], m["osm_id"]) for m in members.collect() for x in lines.collect() if m["relation_id"] == x["relation_id"]}
    assert {tuple(r) for r in S.line_calls(rels).collect()} == want and want


def test_members_are_listed_in_order(spark, tmp_path):
    items = [(1, 2, 8, 0, 1.0, 1.0, "A"), (1, 1, 9, 0, 1.0, 1.0, "R"), (1, 1, 7, 0, 2.0, 1.0, "N"), (2, 1, 5, 0, 1.0, 1.0, "A"), (9, 1, 5, 0, 1.0, 1.0, "A")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rels = A.rels(spark, str(tmp_path))
    assert rels._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate") == 0
    assert {r["relation_id"]: [tuple(m) for m in r["members"]] for r in rels.collect()} == {1: [("N", 7, ""), ("N", 9, "platform"), ("N", 8, "")], 2: [("N", 5, "stop_exit")]}
