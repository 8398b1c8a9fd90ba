"""Hand-made cases of the build's later steps: what SQL over the driver's tables can't reach."""

import pytest
from pyspark.sql import functions as F

from stopgrid.functions.latin import latin_names, place_latin_names
from stopgrid.plans import steps as S

TAGS = "map<string,string>"
ST = f"station_id int, mode string, key string, osm_type string, osm_id long, name string, names {TAGS}, latin string, country string, lon double, lat double, line_name string, lift_end string, city {TAGS}, settlement {TAGS}, region {TAGS}, boundary_ids array<long>, ski_area string, objects array<struct<type:string,id:bigint>>"
KEYS = [x.split(" ")[0] for x in ST.replace("struct<type:string,id:bigint>", "s").split(", ")]


def stations(spark, *rows):
    base = dict.fromkeys(KEYS) | {"mode": "train", "osm_type": "N", "lon": 0.0, "lat": 0.0, "boundary_ids": [], "objects": []}
    out = []
    for i, r in enumerate(rows, 1):
        x = base | {"station_id": i, "key": f"k{i}", "osm_id": i} | r
        x["names"] = x["names"] or {"name": x["name"]}
        x["latin"] = x["latin"] or x["name"]
        out.append(tuple(x[k] for k in KEYS))
    return spark.createDataFrame(out, ST)


def box(x, y, w, h):
    return [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]]


PARTS = "array<array<array<struct<lon:double,lat:double>>>>"


def boundaries(spark, *rows):
    return spark.createDataFrame(list(rows), f"relation_id long, admin_level int, tags {TAGS}, parts {PARTS}")


def objects(spark, *rows):
    """station number, id, tags, primary, lon, lat"""
    return spark.createDataFrame([("train", f"k{s}", "N", i, t, x, y, p, f"k{s}", False) for s, i, t, p, x, y in rows], f"mode string, key string, osm_type string, osm_id long, tags {TAGS}, lon double, lat double, is_primary boolean, source_key string, poles boolean")


def rels(spark, *rows):
    return spark.createDataFrame(list(rows), f"relation_id long, tags {TAGS}")


M = 1 / 111195.0  # degrees along a meridian


def test_polish_stops(spark):
    at = [(1, 19.9, 50.0), (2, 13.0, 50.0), (3, 23.0, 53.0), (4, 20.0, 49.0)]
    stops = spark.createDataFrame([("N", i, {"name": "x"}, x, y) for i, x, y in at], f"osm_type string, osm_id long, tags {TAGS}, lon double, lat double")
    countries = spark.createDataFrame([("PL", box(14.1, 49.0, 8.0, 5.0)), ("XX", box(0.0, 0.0, 90.0, 90.0))], f"code string, parts {PARTS}")
    assert {r["osm_id"]: r["poles"] for r in S.polish_stops(stops, countries).collect()} == {1: True, 2: False, 3: False, 4: True}  # the border counts


def test_areas_without_stop(spark):
    rows = [("bus", "A5", 1, {"public_transport": "stop_position", "name": "b"}, True), ("bus", "A5", 2, {"public_transport": "platform"}, True), ("bus", "A6", 3, {"public_transport": "platform"}, True), ("tram", "A5", 4, {"name": "a"}, False)]
    ob = spark.createDataFrame([(m, k, "N", i, t, 0.0, 0.0, False, k, p) for m, k, i, t, p in rows], f"mode string, key string, osm_type string, osm_id long, tags {TAGS}, lon double, lat double, is_primary boolean, source_key string, poles boolean")
    got = {r["osm_id"] for r in S.areas_without_stop(ob, rels(spark, (5, {"name": "Area"}), (6, {"x": "nameless"}))).where("is_primary").collect()}
    assert got == {2}


def test_stations_of_areas_and_merged_groups(spark):
    ob = objects(spark, (1, 1, {"name": "Gare (Métro 1)", "name:de": "Bahnhof", "wikidata": "Q1"}, True, 0.0, 0.0), (1, 2, {"name": "Gare"}, True, 0.0, 0.0), (2, 3, {"railway": "station"}, True, 0.0, 0.0))
    ob = ob.withColumn("source_key", F.when(F.col("osm_id") == 2, "other").otherwise(F.col("source_key")))
    empty = spark.createDataFrame([], "relation_id long, group_id long")
    got = S.stations(ob, rels(spark, (9, {"x": "y"})), empty).collect()
    assert [(r["station_id"], r["name"], r["osm_id"], [o["id"] for o in r["objects"]], r["wikidata"]) for r in got] == [(1, "Gare", 2, [1, 2], "Q1")]  # the plain name first; without one no station


def test_station_keys(spark):
    rows = [("train", "Q1", None, 1), ("train", "Q1", "87", 2), ("bus", "Q1", None, 3), ("train", "x", " ", 4), ("train", None, "87", 5), ("train", None, "88", 6)]
    st = spark.createDataFrame([(i, *r[:3], "N", r[3], None) for i, r in enumerate(rows)], "station_id int, mode string, wikidata string, uic_ref string, osm_type string, osm_id long, station_key string")
    assert {r["station_id"]: r["station_key"] for r in S.station_keys(st).collect()} == {0: "N1", 1: "N2", 2: "Q1", 3: "N4", 4: "N5", 5: "UIC88"}


def test_lift_ends(spark):
    path = "array<struct<lon:double,lat:double>>"
    ways = spark.createDataFrame([(1, "aerialway", "G", [(0.0, 0.0), (0.01, 0.01)]), (2, "aerialway", "G", [(0.01, 0.01), (0.02, 0.02)]), (3, "aerialway", "H", [(0.5, 0.5), (0.5, 0.6)]), (4, "funicular", "F", [(0.7, 0.7), (0.8, 0.8)])], f"way_id long, kind string, name string, path {path}")
    ob = spark.createDataFrame([("aerialway", "k", "N", 1, {"name": "there"}, 0.5, 0.5 + 59 * M, True, "k", False), ("aerialway", "k", "N", 2, {"name": "too far"}, 0.5, 0.6 + 61 * M, True, "k", False)], f"mode string, key string, osm_type string, osm_id long, tags {TAGS}, lon double, lat double, is_primary boolean, source_key string, poles boolean")
    st = S.stations(objects(spark, (1, 9, {"name": "S"}, True, 9.0, 9.0)), rels(spark, (9, {"x": "y"})), spark.createDataFrame([], "relation_id long, group_id long"))
    got = {r["station_key"]: (r["station_id"], r["lift_end"], r["lon"]) for r in S.lift_ends(st, ob, ways).where("osm_type = 'W'").collect()}
    assert got == {"W1:lower": (2, "lower", 0.0), "W2:upper": (3, "upper", 0.02), "W3:upper": (4, "upper", 0.5)}  # 1 and 2 go on as one


def test_city_of_a_station(spark):
    b = boundaries(
        spark, (1, 2, {"ISO3166-1:alpha2": "xy"}, box(0.0, 0.0, 1.0, 1.0)), (2, 4, {"name": "Region"}, box(0.0, 0.0, 1.0, 1.0)), (3, 6, {"name": "County"}, box(0.0, 0.0, 1.0, 1.0)),
        (4, 8, {"name": "Town"}, box(0.0, 0.0, 0.5, 0.5)), (5, 5, {"name": "京都市"}, box(0.6, 0.6, 0.2, 0.2)), (6, 4, {"name": "Bruxelles"}, box(0.5, 0.0, 0.2, 0.2)),
    )
    overrides = S.city_overrides(b, spark.createDataFrame([("6", None, None, "Brussel", None, None), (None, "4", "Town", "wrong level", None, None)], "relation_id string, admin_level string, boundary_name string, name string, name_en string, note string"))
    assert {r["relation_id"]: r["name"] for r in overrides.collect()} == {5: None, 6: "Brussel"}
    st = stations(spark, {"name": "a", "lon": 0.25, "lat": 0.25}, {"name": "b", "lon": 0.7, "lat": 0.7}, {"name": "c", "lon": 0.55, "lat": 0.1}, {"name": "d", "lon": 0.9, "lat": 0.9}, {"name": "e", "lon": 5.0, "lat": 5.0}).drop("city", "region", "country", "boundary_ids")
    countries = spark.createDataFrame([("QQ", box(0.8, 0.8, 0.2, 0.2))], f"code string, parts {PARTS}")
    got = {r["name"]: (r["country"], (r["region"] or {}).get("name"), (r["city"] or {}).get("name"), r["city_override"]) for r in S.country_region_city(st, b, overrides, countries).collect()}
    assert got == {"a": ("XY", "Region", "Town", False), "b": ("XY", "Region", "京都市", True), "c": ("XY", "Region", "Brussel", True), "d": ("QQ", "Region", "County", False), "e": (None, None, None, None)}


def test_settlements(spark):
    b = boundaries(spark, (8, 8, {"name": "M"}, box(0.0, 0.0, 0.05, 0.05)))
    places = spark.createDataFrame([(1, "village", {"name": "V"}, 0.02, 0.02), (2, "hamlet", {"name": "H"}, 0.01, 0.0105), (3, "city", {"name": "far city"}, 0.06, 0.01), (4, "town", {"name": "T"}, 0.2, 0.2 + 3900 * M), (5, "hamlet", {"name": "out"}, 0.2, 0.2 + 810 * M)], f"node_id long, place string, tags {TAGS}, lon double, lat double")
    st = stations(spark, {"name": "in", "lon": 0.01, "lat": 0.01, "boundary_ids": [8]}, {"name": "free", "lon": 0.2, "lat": 0.2}, {"name": "cn", "lon": 0.2, "lat": 0.2, "country": "CN"}, {"name": "none", "lon": 7.0, "lat": 7.0}).drop("settlement")
    assert {r["name"]: (r["settlement"] or {}).get("name") for r in S.settlements(st, places, b).collect()} == {"in": "H", "free": "T", "cn": None, "none": None}


def test_platforms_and_tracks(spark):
    pos, plat = {"public_transport": "stop_position"}, lambda r: {"public_transport": "platform", "ref": r}
    rows = [
        (1, 1, plat("1"), False, 0.0, 0.0), (1, 2, pos, False, 0.0, 29 * M), (2, 3, plat("1"), False, 1.0, 0.0), (2, 4, pos, False, 1.0, 31 * M),
        (3, 5, plat("1"), False, 2.0, 0.0), (3, 6, pos, False, 2.0, 10 * M), (3, 7, pos, False, 2.0, -14 * M), (4, 8, plat("1"), False, 3.0, 0.0), (4, 9, pos, False, 3.0, 10 * M), (4, 10, pos, False, 3.0, -16 * M),
        (5, 11, plat("2;10"), False, 4.0, 0.0), (5, 12, {"public_transport": "stop_position", "local_ref": "Voie 1Est"}, False, 4.0, 0.0), (5, 13, plat("3 bis"), False, 4.0, 0.0), (5, 14, plat("3"), False, 4.0, 0.0), (5, 15, plat("no track at all"), False, 4.0, 0.0), (5, 16, pos | {"railway:track_ref": "2"}, False, 4.0, M),
    ]
    st, ob = stations(spark, *({"name": f"s{i}"} for i in range(1, 6))), objects(spark, *rows)
    own = S.platform_stops(st, ob)
    assert {r["osm_id"]: round(r["lat"] / M) for r in own.collect()} == {1: 29, 8: 10}
    tracks = {r["station_id"]: [(t["ref"], t["on_track"]) for t in r["tracks"]] for r in S.station_tracks(st, ob, own).collect()}
    assert tracks[1] == [("1", True)] and tracks[2] == [("1", False)]
    assert sorted(tracks[5]) == [("1 Est", True), ("10", False), ("2", True), ("3", False), ("3 bis", False)]
    refs = [t for t, _ in tracks[5]]
    assert refs.index("3") + 1 == refs.index("3 bis") and refs[-1] == "1 Est"


def test_lift_lines(spark):
    path = "array<struct<lon:double,lat:double>>"
    ways = spark.createDataFrame([(1, "aerialway", "Gondel", [(0.0, 0.0), (0.0, 0.02)]), (2, "funicular", "Bahn", [(1.0, 1.0), (1.0, 1.01)]), (3, "aerialway", "Eins", [(2.0, 2.0), (2.0, 2.01)]), (4, "aerialway", "Zwei", [(2.0, 2.0), (2.01, 2.0)])], f"way_id long, kind string, name string, path {path}")
    ski = spark.createDataFrame([("W", 1, "small", box(-0.1, -0.1, 0.2, 0.2)), ("W", 2, "large", box(-1.0, -1.0, 2.0, 2.0))], f"osm_type string, osm_id long, name string, parts {PARTS}")
    lift = lambda n, x, y, m="aerialway": {"name": n, "mode": m, "lon": x, "lat": y}
    st = stations(spark, lift("Gondel", 50 * M, 10 * M), lift("gondel", 0.0, 0.02), lift("Bahn", 1.0, 1.001, "funicular"), lift("ZWEI", 2.0, 2.0), lift("other", 2.0, 2.0), lift("alone", 0.05, 0.05), {"name": "train", "lon": 0.0, "lat": 0.0}).drop("ski_area")
    got = {r["name"]: (r["line_name"], r["lift_end"], r["ski_area"], round(r["lon"], 6)) for r in S.lift_lines(st, ways, ski).collect()}
    assert got == {"Gondel": ("Gondel", "lower", "small", 0.0), "gondel": ("Gondel", "upper", "small", 0.0), "Bahn": ("Bahn", None, None, 1.0), "ZWEI": ("Zwei", None, None, 2.0), "other": (None, None, None, 2.0), "alone": (None, None, "small", 0.05), "train": (None, None, None, 0.0)}


def test_latin_of_stations_and_places(spark):
    st = stations(spark, {"name": "Москва", "country": "RU", "city": {"name": "Москва"}}, {"name": "Gare", "city": {"name": "Київ", "name:en": "Kyiv"}}, {"name": "Київ", "country": "UA", "names": {"name": "Київ", "int_name": "Kyiv I"}}, {"name": "Химки", "country": "RU", "settlement": {"name": "Химки"}, "region": {"name": "Москва"}}).drop("latin")
    got = {r["station_id"]: (r["latin"], (r["city"] or {}).get("latin"), (r["settlement"] or {}).get("latin"), (r["region"] or {}).get("latin")) for r in place_latin_names(latin_names(st)).collect()}
    assert got == {1: ("Moskva", "Moskva", None, None), 2: ("Gare", None, None, None), 3: ("Kyiv I", None, None, None), 4: ("Khimki", None, "Khimki", "Moskva")}


def test_needs_place(spark):
    b = boundaries(spark, (1, 8, {"name": "Royan"}, box(0.0, 0.0, 1.0, 1.0)), (2, 8, {"name": "Lyon"}, box(0.0, 0.0, 1.0, 1.0)))
    overrides = spark.createDataFrame([], "relation_id long, name string, name_en string")
    places = spark.createDataFrame([("Bergen", 5.0, 5.0)], "n string, lon double, lat double").select(F.create_map(F.lit("name"), "n").alias("tags"), "lon", "lat")
    city = {"city": {"name": "x"}}
    bus = lambda n, **k: {"name": n, "mode": "bus", **city, **k}
    st = stations(
        spark, bus("Gare", boundary_ids=[1]), bus("Gare", boundary_ids=[2]), bus("Gare de Lyon", boundary_ids=[2]), {"name": "Unique", **city}, bus("Solo"), {"name": "Nowhere", "mode": "bus"},
        bus("Bergen", lon=5.0, lat=5.0, country="DE"), bus("Bergen", lon=5.0, lat=5.01, country="NO"), bus("Bergen", lon=5.0, lat=5.01, country="NO"),
    )
    got = {r["station_id"]: r["needs_place"] for r in S.needs_place(st, b, overrides, places).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: True}


def test_search_names(spark):
    st = stations(spark, {"name": "Gare", "names": {"name": "Gare; Bahnhof ", "name:de": "Hbf"}, "city": {"name": "Lyon", "name:en": "Lyons"}, "region": {"name": "Rhône"}, "line_name": "Gondel"}, {"name": "Lyon Est", "city": {"name": "Lyon"}, "settlement": {"name": "Zug"}})
    ob = objects(spark, (1, 1, {"name": "Gare Sud", "uic_ref": "8727100", "railway:ref": "KGX; no;NO"}, True, 0.0, 0.0), (1, 2, {"name": "not primary"}, False, 0.0, 0.0))
    rows = S.search_names(st, ob, rels(spark, (9, {"x": "y"}))).collect()
    plain = {(r["station_id"], r["name"]) for r in rows if not r["city_prefixed"] and not r["code"]}
    assert plain == {(1, n) for n in ("Gare", "Bahnhof", "Hbf", "Gondel Gare", "Gondel Bahnhof", "Gondel Hbf", "Gare Sud")} | {(2, "Lyon Est")}
    assert {r["name"] for r in rows if r["code"]} == {"8727100", "KGX", "NO"}
    placed = {(r["name"], r["place"]) for r in rows if r["city_prefixed"] and r["station_id"] == 2}
    assert placed == {("Zug Lyon Est", "zug"), ("Lyon Est Zug", None)}  # the name says Lyon already
    first = {(r["name"], r["place"]) for r in rows if r["city_prefixed"] and r["station_id"] == 1}
    assert {("Lyon Gare", "lyon"), ("Gare Lyon", None), ("Lyons Gare", "lyons"), ("Rhône Hbf", "rhone")} <= first


@pytest.mark.parametrize("n", [0, 1])
def test_weights_and_lines(spark, n):
    st = stations(spark, {"name": "a"}, {"name": "b"}).withColumn("weight", F.lit(1.0))
    ob = objects(spark, (1, 1, {"public_transport": "stop_position"}, True, 0.0, 0.0), (1, 2, {"x": "y"}, True, 1.0, 1.0), (2, 3, {"x": "y"}, True, 4.0, 2.0), (2, 4, {"x": "y"}, True, 2.0, 4.0))
    r = rels(spark, (1, {"route": "train", "ref": "L1", "colour": "red"}), (2, {"route": "train", "ref": "L10"}), (3, {"route": "bus", "ref": "B"}))
    calls = spark.createDataFrame([(k, 1, "N", i) for k, i in [(1, 1), (2, 1), (1, 2), (3, 3), (2, 3), (2, 4)]], "relation_id long, seq int, osm_type string, osm_id long")
    if n:
        import math

        got = {x["name"]: x["weight"] for x in S.weights(st, calls, r, ob).collect()}
        assert got == pytest.approx({"a": 1 + 2 * math.log(3), "b": 1 + 2 * math.log(2)})
    else:
        lines = S.line_routes(r)
        got = {x["name"]: [(y["ref"], y["colour"], y["lng"], y["lat"]) for y in x["lines"]] for x in S.station_lines(st, ob, calls, lines).collect()}
        assert got == {"a": [("L1", "red", 0.0, 0.0), ("L10", None, 0.0, 0.0)], "b": [("L10", None, 3.0, 3.0)]}
