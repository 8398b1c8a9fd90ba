"""Hand-made cases of the build steps and of the serving helpers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stopgrid.functions.latin import Row, latin_table, resolve
from stopgrid.functions.paths import drawn_order, drawn_stretch
from stopgrid.plans import publish as P
from stopgrid.plans import serve as V
from stopgrid.plans import steps as S

STOP = "osm_type string, osm_id long, tags map<string,string>, lon double, lat double, poles boolean"


def stops(spark, *rows):
    return spark.createDataFrame([("N", i, t, lon, lat, False) for i, t, lon, lat in rows], STOP)


def rels(spark, *rows):
    return spark.createDataFrame([(i, t, [("N", m, r) for m, r in ms]) for i, t, ms in rows], "relation_id long, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>")


def test_route_stops_and_lines(spark):
    r = rels(spark, (1, {"route": "train", "ref": "L1"}, [(1, "stop"), (2, "platform"), (3, "stop_exit")]), (2, {"route": "train", "ref": "TGV 505"}, [(1, ""), (2, "")]), (3, {"route": "light_rail", "ref": "6033"}, [(1, "")]))
    assert sorted(map(tuple, S.route_stops(S.rel_members(r)).select("relation_id", "osm_id").collect())) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1)]
    assert sorted(map(tuple, S.line_routes(r).select("relation_id", "mode").collect())) == [(1, "train"), (3, "metro"), (3, "tram")]


def test_areas_share_primary_stops_only(spark):
    s = stops(spark, (1, {"railway": "station", "name": "Xanten"}, 0.0, 0.0), (2, {"railway": "subway_entrance"}, 0.0, 0.0))
    area = {"public_transport": "stop_area"}
    r = rels(spark, (10, area, [(1, "")]), (11, area, [(1, ""), (2, "")]), (12, area, [(2, "")]))
    assert sorted(map(tuple, S.area_group(S.rel_members(r), s).collect())) == [(10, 10), (11, 10), (12, 12)]


@pytest.mark.parametrize(
    ("tags", "modes"),
    [
        ({"railway": "station", "station": "rail"}, {"train"}),
        ({"railway": "station", "station": "train;subway"}, {"train"}),
        ({"railway": "station", "station": "subway", "train": "yes"}, {"metro"}),
        ({"railway": "station", "station": "light_rail", "train": "yes"}, {"train", "metro", "tram"}),
        ({"railway": "station", "station": "preserved_railway"}, {"train"}),
        ({"highway": "bus_stop"}, {"bus"}),
        ({"shop": "x"}, set()),
    ],
)
def test_stop_modes(spark, tags, modes):
    assert {r["mode"] for r in S.stop_modes(stops(spark, (1, tags, 0.0, 0.0))).collect()} == modes


def test_merges_are_transitive_within_400_m(spark):
    name = lambda n: {"highway": "bus_stop", "name": n}
    s = stops(spark, (1, name("Royan - Gare"), 0.0, 45.0), (2, name("Gare"), 0.004, 45.0), (3, name("Gare (E)"), 0.008, 45.0), (4, name("Gare"), 0.02, 45.0))
    empty = rels(spark, (99, {"x": "y"}, [(1, "")])).where("false")
    members = S.rel_members(empty)
    objects = S.station_objects(s, S.stop_modes(s), members, S.area_group(members, s))
    out = S.merge_groups(objects, S.near_duplicates(S.named_groups(objects, empty)))
    assert {r["osm_id"]: r["key"] for r in out.collect()} == {1: "N1", 2: "N1", 3: "N1", 4: "N4"}


def test_strays_and_bus_stations(spark):
    at = lambda m: m / 111195.0  # noqa: E731  metres along a meridian
    s = stops(spark, (1, {"highway": "bus_stop", "name": "Main"}, 0.0, 0.0), (2, {"public_transport": "platform", "bus": "yes"}, 0.0, at(300)), (3, {"public_transport": "platform", "bus": "yes"}, 0.0, -at(401)))
    empty = rels(spark, (99, {"x": "y"}, [(1, "")])).where("false")
    members = S.rel_members(empty)
    build = lambda s: S.station_objects(s, S.stop_modes(s), members, S.area_group(members, s))
    assert {r["osm_id"]: r["key"] for r in S.attach_strays(build(s)).collect()} == {1: "N1", 2: "N1", 3: "N3"}
    b = stops(spark, (1, {"amenity": "bus_station"}, 0.0, 0.0), (2, {"highway": "bus_stop"}, 0.0, at(79)), (3, {"highway": "bus_stop"}, 0.0, -at(81)))
    assert {r["osm_id"]: r["key"] for r in S.bus_stations(build(b)).collect()} == {1: "N1", 2: "N1", 3: "N3"}


def brute_order(stops):
    """Repeats dropped; then of all starts of the farthest pairs, the chain of nearest stops, if it is 1.3 times shorter."""
    met = lambda a, b: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    once = {}
    for s in stops:
        once.setdefault((s[2] or "").strip().lower() or tuple(round(x, 4) for x in s[:2]), s)
    given = list(once.values())
    if len(given) < 3:
        return given
    best, start = -1.0, 0
    for i, a in enumerate(given):
        for b in given[i + 1 :]:
            if met(a, b) > best:
                best, start = met(a, b), i
    order = [start]
    while len(order) < len(given):
        order.append(min((i for i in range(len(given)) if i not in order), key=lambda i: met(given[order[-1]], given[i])))
    walk = lambda c: sum(met(a, b) for a, b in zip(c, c[1:], strict=False))
    chain = [given[i] for i in order]
    if walk(chain) >= walk(given) / 1.3:
        return given
    return chain[::-1] if met(given[0], chain[-1]) < met(given[0], chain[0]) else chain


def test_drawn_order_against_brute_force(spark):
    rng = random.Random(2)
    routes = [[(0.0, 0.0, "A"), (0.0, 1.0, "B"), (0.0, 2.0, "C"), (0.0, 1.0, "b ")], [(1.0, 1.0, None)], [], [(0.0, 0.0, None), (0.0, 0.00001, ""), (0.0, 1.0, "x")]]
    for n in (2, 3, 5, 9, 30):
        for _ in range(6):
            line = [(48 + i / 50 + rng.random() / 200, 2 + i / 90, rng.choice([None, f"s{i}", f" S{i % 7}"])) for i in range(n)]
            routes += [line, rng.sample(line, n), line + line[::-1]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(routes)], f"id int, stops array<{V.STOP}>").select("id", drawn_order(F.col("stops")).alias("o"))
    got = {r["id"]: [(x["lat"], x["lng"], x["name"]) for x in r["o"]] for r in df.collect()}
    assert got == {i: brute_order(r) for i, r in enumerate(routes)}
    assert any(brute_order(r) != r for r in routes)


def test_drawn_stretch(spark):
    rows = [(1, [(0.0, 0.0, True), (0.0, 5.0, False), (0.0, 1.0, True)]), (2, [(0.0, 0.0, False), (0.0, 0.5, True), (0.0, 1.0, False)]), (3, [(0.0, 0.0, False), (0.2, 0.5, None), (0.0, 1.0, True)]), (4, [(1.0, 2.0, True)]), (5, [])]
    df = spark.createDataFrame(rows, "id int, p array<struct<lat:double,lng:double,platform:boolean>>").select("id", drawn_stretch(F.col("p")).alias("o"))
    got = {r["id"]: [tuple(x) for x in r["o"]] for r in df.collect()}
    assert got == {1: [(0.0, 0.0), (0.0, 1.0)], 2: [(0.0, 0.0), (0.0, 1.0)], 3: [(0.0, 0.0), (0.2, 0.5), (0.0, 1.0)], 4: [(1.0, 2.0)] * 2, 5: []}


def test_redirects_and_usage(spark):
    st = lambda *rows: spark.createDataFrame(rows, "mode string, key string, station_key string")
    ob = lambda *rows: spark.createDataFrame(rows, "mode string, key string, osm_type string, osm_id long")
    old = {"stations": st(("m", "a", "OLD"), ("m", "z", "GONE")), "objects": ob(*[("m", "a", "N", i) for i in range(3)], ("m", "z", "N", 99)), "redirects": spark.createDataFrame([("m", "OLDER", "OLD")], "mode string, old_key string, new_key string")}
    new = {"stations": st(("m", "p", "P"), ("m", "q", "Q")), "objects": ob(("m", "p", "N", 0), ("m", "q", "N", 1), ("m", "q", "N", 2))}
    r = P.key_redirects(old, new)
    assert sorted(map(tuple, r.collect())) == [("m", "OLD", "Q"), ("m", "OLDER", "Q")]
    usage = spark.createDataFrame([("m", "OLD", 3), ("m", "Q", 4), ("m", "P", 1)], "mode string, station_key string, users long")
    assert sorted(map(tuple, P.follow_redirects(usage, r).collect())) == [("m", "P", 1), ("m", "Q", 7)]


def test_latin_rules():
    table = {("Russian-Latin/BGN", "Москва"): "Moskva", ("Han-Latin", "成都东"): "chéng dōu dōng", ("Any-Latin", "กทม"): "kthm"}
    run = lambda name, texts: [table.get((name, t), "") for t in texts]
    cases = [
        ({"name": "Gare"}, "FR", "Gare"), ({"name": "Москва", "name:en": "Moskwa"}, "RU", "Moskva"), ({"name": "Москва", "name:en": "Moskva!"}, "RU", "Moskva!"),
        ({"name": "成都东"}, "CN", "Chengdoudong"), ({"name": "東京", "name:en": "Tokyo"}, "JP", "Tokyo"), ({"name": "x", "int_name": "I"}, None, "I"),
        ({"name": "กทม"}, "TH", "kthm"), ({"name": "東京"}, "JP", "東京"), ({"name": "Москва", "name:ru-Latn": "Moscou"}, "RU", "Moscou"), ({"name": "BRT2成都东(A)"}, "CN", "BRT2 Chengdoudong (A)"), ({}, None, ""),
    ]
    assert resolve([Row(n, c) for n, c, _ in cases], run) == [w for _, _, w in cases]


def test_latin_table_runs_on_executors(spark):
    rows = [({"name": "Москва"}, "RU"), ({"name": "Київ"}, "UA"), ({"name": "Αθήνα"}, "GR"), ({"name": "Улаанбаатар ᠤᠯᠠᠭᠠᠨ"}, "MN"), ({"name": "Тбилиси"}, None), ({"name": "თბილისი"}, "GE"), ({"name": "荷花池街道"}, "CN"), ({"name": "Москва"}, "RU")]
    got = {(r["e"][0]["value"], r["country"]): r["latin"] for r in latin_table(spark.createDataFrame(rows, "names map<string,string>, country string").repartition(4)).collect()}
    assert got[("Москва", "RU")] == "Moskva" and got[("荷花池街道", "CN")] == "Hehuachijiedao" and got[("თბილისი", "GE")] == "Tbilisi"
    assert len(got) == 7 and got[("Улаанбаатар ᠤᠯᠠᠭᠠᠨ", "MN")].startswith("Ulaanba")


def test_search_tiers(spark):
    names = [(1, "train", "Agen Gare", False, None, False), (2, "train", "Agence Commerciale", False, None, False), (3, "train", "MAN", False, None, True), (4, "train", "Mantes", False, None, False), (5, "train", "Kievo", False, None, False)]
    n = S.fold_column(spark.createDataFrame(names, "station_id int, mode string, name string, city_prefixed boolean, place string, code boolean"))
    st = spark.createDataFrame([(i, "train", f"K{i}", f"n{i}", 1.0, 2.0, 48.0) for i in range(1, 6)], "station_id int, mode string, station_key string, name string, weight double, lon double, lat double")
    usage = spark.createDataFrame([], "mode string, station_key string, users long")
    t = V.Tables(st, None, n, None, usage, None, None, None, None, None)
    order = lambda q: [(r["station_id"], r["tier"]) for r in V.search(t, q).collect()]
    assert order("agen") == [(1, 0), (2, 1)]
    assert order("MAN")[0] == (3, 0) and order("man")[0][1] == 1
    assert order("-- ") == [] and order("a") == []
    assert F.col("x") is not None
