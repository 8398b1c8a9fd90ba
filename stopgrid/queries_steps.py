"""Sources, sinks, build steps and serving queries, over the adapters. SQL is given where the other engine can say the same; the others are
held by tests to hand-made cases (tests/test_steps.py, test_build_steps.py, test_serve.py)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_chain as C
from .functions import geo, latin
from .operators.spatial import subdivide
from .operators.tables import fresh_path, written
from .plans import adapters as A
from .plans import publish as P
from .plans import serve as V
from .plans import steps as S
from .plans.build import build
from .registry import Registry, load, run_sql
from .sources import raw as W

R = Registry()
Q = Callable[[SparkSession, str], DataFrame]


def duck(sql: str) -> str:
    for name in ("customer", "orders", "lineitem", "supplier", "nation", "region"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("VARCHAR(9)", "VARCHAR")


# --- one build for each session and folder: steps and serving queries read the tables that it wrote
_built: dict[tuple[str, str], dict[str, DataFrame]] = {}
WRITTEN = ("rels", "stops", "stations", "station_objects", "rel_members", "route_stops", "line_routes")  # by the build itself


def built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        out = build(A.raw(spark, sf_dir))
        _built[key] = {k: v if k in WRITTEN else written(v, f"built-{k}") for k, v in out.items()}
    return _built[key]


def tables(spark: SparkSession, sf_dir: str) -> V.Tables:
    b = built(spark, sf_dir)
    usage = b["stations"].where("station_key is not null and station_id % 3 = 0").select("mode", "station_key", (F.col("station_id") % 7 + 1).cast("long").alias("users"))
    redirects = spark.createDataFrame([("train", "gone", "N12")], "mode string, old_key string, new_key string")
    return V.Tables(b["stations"], b["station_objects"], b["station_names"], redirects, usage, b["rels"], b["stops"], b["rel_members"], b["route_stops"], b["line_routes"])


# --- sources and sinks
R.same("src_raw_pg", "SELECT osm_type, osm_id, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (" + A.STOPS + ")")
R.oracles["src_raw_pg"] = "SELECT osm_type, osm_id, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (" + duck(A.STOPS) + ")"


@R.frame("src_json_tags", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def src_json_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.typed_tags(load(spark, sf_dir, "events").withColumnRenamed("props", "tags")).select("event_id", F.col("tags")["k"].alias("k"))


@R.frame("src_geojson", "SELECT 'C' || n_nationkey AS code, 1 + n_nationkey % 2 AS parts, 5 * (1 + n_nationkey % 2) AS points FROM nation")
def src_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    one, two = json.dumps({"type": "Polygon", "coordinates": [ring]}), json.dumps({"type": "MultiPolygon", "coordinates": [[ring], [ring]]})
    feature = F.concat(F.lit('{"properties": {"countryCode": "C'), "n_nationkey", F.lit('"}, "geometry": '), F.when(F.col("n_nationkey") % 2 == 0, one).otherwise(two), F.lit("}"))
    path = fresh_path(spark, "geojson")
    load(spark, sf_dir, "nation").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return W.read_geojson(spark, path).select("code", F.size("parts").alias("parts"), F.size(F.flatten(F.flatten("parts"))).alias("points"))


@R.frame("src_csv_comment", "SELECT CAST(n_nationkey AS VARCHAR) AS relation_id, n_name AS name FROM nation")
def src_csv_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "overrides")
    rows = F.concat_ws(",", "n_nationkey", F.lit(""), F.lit(""), "n_name", F.lit(""), F.lit(""))
    body = load(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list(rows)), "\n").alias("b"))
    body.select(F.concat(F.lit("# a comment\nrelation_id,admin_level,boundary_name,name,name_en,note\n# more\n"), "b").alias("value")).coalesce(1).write.text(path)
    return W.read_overrides(spark, path).select("relation_id", "name")


@R.frame("src_csv_usage", "SELECT o_orderstatus AS mode, CAST(o_custkey % 50 AS VARCHAR) AS station_key, CAST(count(*) * 2 AS BIGINT) AS users FROM orders GROUP BY ALL")
def src_csv_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "usage")
    load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mode"), (F.col("o_custkey") % 50).alias("station_key"), F.lit(2).alias("users"), F.lit(1).alias("trips")).write.option("header", True).csv(path)
    return W.read_usage(spark, path)


#: Object types, keys and values to keep (a parameter of the fetch).
RULES = """nwr/railway=station,halt,tram_stop
nwr/public_transport
nwr/highway=bus_stop
w/aerialway
nwr/amenity=bus_station,ferry_terminal
r/route=subway,light_rail,monorail,tram,train"""


@R.frame("src_tag_filter", f"SELECT osm_id FROM ({duck(A.STOPS)}) WHERE railway IN ('station', 'halt', 'tram_stop') OR public_transport IS NOT NULL OR highway = 'bus_stop' OR amenity IN ('bus_station', 'ferry_terminal')")
def src_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tag_filter(A.stops(spark, sf_dir).withColumn("type", F.lit("n")), RULES).select("osm_id")


@R.frame("src_latest_version", "SELECT type, id, version FROM (SELECT o_orderstatus AS type, o_custkey AS id, o_orderkey AS version, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey DESC) AS rk FROM orders) WHERE rk = 1")
def src_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest(run_sql(spark, sf_dir, "SELECT o_orderstatus AS type, o_custkey AS id, o_orderkey AS version FROM {orders}"))


@R.frame("src_node_extract", f"SELECT 'stop' AS kind, osm_id AS id FROM ({duck(A.STOPS)}) WHERE railway IN ('station', 'tram_stop') OR public_transport IS NOT NULL OR highway IS NOT NULL OR amenity IS NOT NULL OR aerialway IS NOT NULL UNION ALL SELECT 'place', node_id FROM ({duck(A.PLACES)})")
def src_node_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = A.stops(spark, sf_dir).select(F.col("osm_id").alias("id"), "tags", "lon", "lat").unionByName(A.places(spark, sf_dir).select(F.col("node_id").alias("id"), "tags", "lon", "lat"))
    stops, places = W.extract_nodes(nodes)
    return stops.select(F.lit("stop").alias("kind"), F.col("osm_id").alias("id")).unionByName(places.select(F.lit("place").alias("kind"), F.col("node_id").alias("id")))


@R.frame("src_way_extract", "SELECT kind, id FROM (VALUES ('aerialway', CAST(1 AS BIGINT)), ('aerialway', 2), ('aerialway', 3), ('funicular', 4), ('ski', 101), ('ski', 102)) AS t(kind, id)")
def src_way_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw(spark, sf_dir)
    lifts = raw["line_ways"].select(F.col("way_id").alias("id"), F.map_filter(F.create_map(F.lit("name"), "name", F.lit("aerialway"), F.when(F.col("kind") == "aerialway", F.lit("gondola")), F.lit("railway"), F.when(F.col("kind") == "funicular", F.lit("funicular"))), lambda k, v: v.isNotNull()).alias("tags"), "path")
    areas = raw["ski_areas"].select((F.col("osm_id") + 100).alias("id"), F.create_map(F.lit("name"), "name", F.lit("landuse"), F.lit("winter_sports")).alias("tags"), F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("path"))
    _, lines, ski = W.extract_ways(lifts.unionByName(areas))
    return lines.select("kind", F.col("way_id").alias("id")).unionByName(ski.select(F.lit("ski").alias("kind"), F.col("osm_id").alias("id")))


@R.frame("src_rel_extract", f"SELECT 'rel' AS kind, relation_id AS id FROM ({duck(A.RELS)}) r WHERE EXISTS (SELECT 1 FROM ({duck(A.MEMBERS)}) m WHERE m.relation_id = r.relation_id) UNION ALL SELECT 'boundary', relation_id + 1000000000 FROM ({duck(A.RECTANGLES)})")
def src_rel_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "cast(array() as array<array<array<struct<lon:double,lat:double>>>>)"
    own = A.rels(spark, sf_dir).select(F.col("relation_id").alias("id"), "tags", "members", F.expr(none).alias("parts"))
    admin = A.boundaries(spark, sf_dir).select((F.col("relation_id") + 1000000000).alias("id"), F.map_concat(F.col("tags"), F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), F.col("admin_level").cast("string"))).alias("tags"), F.expr(f"cast(array() as {W.MEMBERS.replace('bigint', 'long')})").alias("members"), "parts")
    _, boundaries, rels = W.extract_relations(own.unionByName(admin))
    return rels.select(F.lit("rel").alias("kind"), F.col("relation_id").alias("id")).unionByName(boundaries.select(F.lit("boundary").alias("kind"), F.col("relation_id").alias("id")))


R.frame("src_bulk_python", "SELECT * FROM (VALUES (1, 'a,\"b'), (2, NULL)) AS t(id, name)")(lambda spark, sf_dir: spark.createDataFrame([(1, 'a,"b'), (2, None)], "id int, name string"))


@R.frame("sink_publish", "SELECT o_orderstatus AS mode, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "published")
    names = run_sql(spark, sf_dir, "SELECT o_orderstatus AS mode, o_orderpriority AS folded FROM {orders}")
    P.publish({"station_names": names}, root)
    return P.read_live(spark, root, "station_names").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@R.frame("sink_atomic_swap", "SELECT 2 AS versions, count(*) AS n FROM region")
def sink_atomic_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "swapped")
    first = P.publish({"t": load(spark, sf_dir, "nation")}, root)
    second = P.publish({"t": load(spark, sf_dir, "region")}, root)
    return P.read_live(spark, root, "t").agg(F.lit(2 if first != second else 1).alias("versions"), F.count(F.lit(1)).alias("n"))


R.frame("sink_prewarm", "SELECT count(*) AS n FROM nation")(lambda spark, sf_dir: P.prewarm(load(spark, sf_dir, "nation")).agg(F.count(F.lit(1)).alias("n")))


@R.frame("sink_usage", "SELECT o_orderstatus AS mode, count(*) AS users FROM orders GROUP BY o_orderstatus")
def sink_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("mode")).agg(F.count(F.lit(1)).alias("users")), "usage")


# --- steps with SQL: the flat adapters as views of one WITH clause
MODE_LIST = "(VALUES ('metro', 'subway'), ('metro', 'light_rail'), ('metro', 'monorail'), ('tram', 'tram'), ('tram', 'light_rail'), ('train', 'train'))"
PRIMARY = "(coalesce(railway IN ('station', 'tram_stop'), false) OR coalesce(highway = 'bus_stop', false) OR coalesce(amenity IN ('bus_station', 'ferry_terminal'), false) OR coalesce(aerialway = 'station', false))"
VIEWS = {
    "st": f"({duck(A.STOPS)})",
    "re": f"(SELECT * FROM ({duck(A.RELS)}) x WHERE relation_id IN (SELECT l_orderkey FROM lineitem))",
    "me": f"(SELECT m.*, r.public_transport = 'stop_area' AS is_stop_area, r.route FROM ({duck(A.MEMBERS)}) m JOIN ({duck(A.RELS)}) r USING (relation_id))",
    "calls": "(SELECT relation_id, seq, osm_type, osm_id FROM (SELECT *, bool_or(starts_with(role, 'stop')) OVER (PARTITION BY relation_id) AS any_stop FROM me WHERE route IS NOT NULL) WHERE starts_with(role, 'stop') OR NOT any_stop)",
    "lines": f"(SELECT relation_id, m.mode, ref, colour FROM re JOIN {MODE_LIST} AS m(mode, route) USING (route) WHERE ref IS NOT NULL AND NOT (m.mode = 'train' AND (regexp_matches(ref, '[0-9]{{3}}') OR coalesce(service, '') = 'night')))",
    "links": f"(SELECT DISTINCT x.relation_id AS a, y.relation_id AS b FROM me x JOIN me y ON x.osm_id = y.osm_id JOIN st s ON s.osm_id = x.osm_id WHERE x.is_stop_area AND y.is_stop_area AND {PRIMARY.replace('(railway', '(s.railway')})",
    "areas": "(SELECT DISTINCT relation_id FROM me WHERE is_stop_area)",
    "grp(relation_id, group_id) USING KEY (relation_id)": "(SELECT relation_id, relation_id FROM areas UNION (SELECT l.a, min(g.group_id) FROM links l JOIN grp g ON g.relation_id = l.b JOIN recurring.grp o ON o.relation_id = l.a WHERE g.group_id < o.group_id GROUP BY l.a))",
    "modes": "(SELECT osm_type, osm_id, unnest(list_filter([CASE WHEN railway = 'station' AND station IS NULL OR train = 'yes' AND station IS NULL THEN 'train' END, CASE WHEN station = 'subway' THEN 'metro' END, CASE WHEN railway = 'tram_stop' OR tram = 'yes' THEN 'tram' END, CASE WHEN highway = 'bus_stop' OR amenity = 'bus_station' OR bus = 'yes' THEN 'bus' END, CASE WHEN amenity = 'ferry_terminal' THEN 'ferry' END, CASE WHEN aerialway = 'station' THEN 'aerialway' END], lambda x: x IS NOT NULL)) AS mode FROM st)",
    "obj": f"(SELECT m.mode, coalesce('A' || a.group_id, 'Q' || s.wikidata, s.osm_type || s.osm_id) AS key, s.*, {PRIMARY} AS is_primary FROM modes m JOIN st s USING (osm_type, osm_id) LEFT JOIN (SELECT osm_id, min(group_id) AS group_id FROM me JOIN grp USING (relation_id) GROUP BY osm_id) a USING (osm_id))",
    "shared": "(SELECT 'train' AS mode, o.key, o.osm_id FROM obj o WHERE o.mode = 'metro' AND o.is_primary AND o.train = 'yes' AND EXISTS (SELECT 1 FROM obj t WHERE t.mode = 'train' AND t.key = o.key AND t.public_transport = 'stop_position' AND NOT EXISTS (SELECT 1 FROM modes m WHERE m.osm_id = t.osm_id AND m.mode = 'metro')) AND NOT EXISTS (SELECT 1 FROM obj t WHERE t.mode = 'train' AND t.key = o.key AND t.is_primary))",
    "named": "(SELECT DISTINCT ON (o.mode, o.key) o.mode, o.key, lower(coalesce(o.name, r.name)) AS name, o.lon, o.lat FROM obj o LEFT JOIN re r ON o.key = 'A' || r.relation_id WHERE o.is_primary ORDER BY o.mode, o.key, (o.name IS NOT NULL) DESC, o.osm_id)",
    "bare": "(SELECT mode, key, trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) AS name, lon * 111320 * cos(radians(lat)) AS x, lat * 110540 AS y FROM named WHERE name <> '')",
    "pairs": "(SELECT a.mode, a.key AS a, b.key AS b FROM bare a JOIN bare b ON a.mode = b.mode AND a.name = b.name AND a.key < b.key AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 160000)",
    "sym": "(SELECT mode, a, b FROM pairs UNION SELECT mode, b, a FROM pairs)",
    "chain(mode, a, b) USING KEY (mode, a)": "(SELECT DISTINCT mode, a, a FROM sym UNION (SELECT s.mode, s.a, min(c.b) FROM sym s JOIN chain c ON c.mode = s.mode AND c.a = s.b JOIN recurring.chain o ON o.mode = s.mode AND o.a = s.a WHERE c.b < o.b GROUP BY s.mode, s.a))",
    "merged": "(SELECT o.mode, o.osm_id, coalesce(least(o.key, m.to_key), o.key) AS key, o.is_primary FROM obj o LEFT JOIN (SELECT mode, a AS key, b AS to_key FROM chain) m USING (mode, key))",
}

VIEWS |= C.views(duck(A.RECTANGLES), duck(A.PLACES))


def sql_of(body: str, upto: str) -> str:
    out = []
    for k, v in VIEWS.items():
        out.append(f"{k} AS {v}")
        if k.split("(")[0] == upto:
            break
    return f"WITH RECURSIVE {', '.join(out)} {body}"


def parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    stops, rels = A.stops(spark, sf_dir).withColumn("poles", F.lit(False)), A.rels(spark, sf_dir)
    members = S.rel_members(rels)
    return {"stops": stops, "rels": rels, "members": members, "modes": S.stop_modes(stops)}


def objects_of(p: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    groups = S.area_group(p["members"], p["stops"])
    return written(S.station_objects(p["stops"], p["modes"], p["members"], groups), "objects"), groups  # steps read it several times


def step(name: str, body: str, upto: str) -> Callable[[Callable[[dict[str, DataFrame]], DataFrame]], None]:
    def add(f: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        R.frame(name, sql_of(body, upto))(lambda spark, sf_dir: f(parts(spark, sf_dir)))

    return add


R.frame("st_load", f"SELECT 'stops' AS t, count(*) AS n FROM ({duck(A.STOPS)}) UNION ALL SELECT 'places', count(*) FROM supplier UNION ALL SELECT 'boundaries', count(*) FROM ({duck(A.RECTANGLES)})")(
    lambda spark, sf_dir: A.stops(spark, sf_dir).agg(F.lit("stops").alias("t"), F.count(F.lit(1)).alias("n")).unionByName(A.places(spark, sf_dir).agg(F.lit("places").alias("t"), F.count(F.lit(1)).alias("n"))).unionByName(A.boundaries(spark, sf_dir).agg(F.lit("boundaries").alias("t"), F.count(F.lit(1)).alias("n")))
)
step("st_setup", f"SELECT osm_id, {PRIMARY} AS is_primary FROM st", "st")(lambda p: p["stops"].select("osm_id", S.is_primary_stop().alias("is_primary")))
step("st_rel_members", "SELECT relation_id, is_stop_area, route, osm_type, osm_id, role, seq FROM me", "me")(lambda p: p["members"])
step("st_route_stops", "SELECT * FROM calls", "calls")(lambda p: S.route_stops(p["members"]))
step("st_line_routes", "SELECT relation_id, mode, ref FROM lines", "lines")(lambda p: S.line_routes(p["rels"]).select("relation_id", "mode", F.col("tags")["ref"].alias("ref")))
step("st_area_group", "SELECT * FROM grp", "grp")(lambda p: S.area_group(p["members"], p["stops"]))
step("st_stop_modes", "SELECT * FROM modes", "modes")(lambda p: p["modes"])
step("st_station_objects", "SELECT mode, key, osm_id, is_primary FROM obj", "obj")(lambda p: objects_of(p)[0].select("mode", "key", "osm_id", "is_primary"))
step("st_shared_metro", "SELECT mode, key, osm_id, is_primary FROM obj UNION ALL SELECT mode, key, osm_id, true FROM shared", "shared")(lambda p: S.shared_metro(objects_of(p)[0], p["modes"]).select("mode", "key", "osm_id", "is_primary"))
step("st_untagged_positions", "SELECT DISTINCT a.mode, a.key, s.osm_id FROM (SELECT DISTINCT mode, key FROM obj WHERE starts_with(key, 'A')) a JOIN grp g ON a.key = 'A' || g.group_id JOIN me m ON m.relation_id = g.relation_id JOIN st s ON s.osm_id = m.osm_id WHERE s.osm_id NOT IN (SELECT osm_id FROM modes)", "obj")(
    lambda p: (lambda o, g: S.untagged_positions(o.where("false").unionByName(o), p["stops"], p["modes"], p["members"], g).join(p["modes"].select("osm_id").distinct(), "osm_id", "left_anti").select("mode", "key", "osm_id"))(*objects_of(p))
)
step("st_near_duplicates", "SELECT * FROM pairs", "pairs")(lambda p: S.near_duplicates(S.named_groups(objects_of(p)[0], p["rels"])))


def merged(p: dict[str, DataFrame]) -> DataFrame:
    o = objects_of(p)[0]
    return S.merge_groups(o, S.near_duplicates(S.named_groups(o, p["rels"])))


step("st_merge_groups", "SELECT mode, key, osm_id FROM merged", "merged")(lambda p: merged(p).select("mode", "key", "osm_id"))
HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
step("st_attach_strays", f"SELECT mode, coalesce(to_key, key) AS key, osm_id FROM obj LEFT JOIN (SELECT DISTINCT ON (mode, key) mode, key, to_key FROM (SELECT a.mode, a.key, b.key AS to_key, {HAV} AS d FROM (SELECT DISTINCT ON (mode, key) * FROM obj WHERE (mode, key) NOT IN (SELECT (mode, key) FROM obj WHERE is_primary) ORDER BY mode, key, osm_id) a JOIN obj b ON b.mode = a.mode AND b.is_primary) WHERE d <= 400 ORDER BY mode, key, d, to_key) n USING (mode, key)", "obj")(lambda p: S.attach_strays(objects_of(p)[0]).select("mode", "key", "osm_id"))
step("st_bus_stations", f"SELECT mode, CASE WHEN mode = 'bus' THEN coalesce(to_key, key) ELSE key END AS key, osm_id FROM obj LEFT JOIN (SELECT DISTINCT ON (key) key, to_key FROM (SELECT a.key, b.key AS to_key, {HAV} AS d FROM (SELECT * FROM obj WHERE mode = 'bus' AND is_primary AND key NOT IN (SELECT key FROM obj WHERE mode = 'bus' AND amenity = 'bus_station')) a, (SELECT DISTINCT ON (key) * FROM obj WHERE mode = 'bus' AND amenity = 'bus_station' ORDER BY key, osm_id) b) WHERE d <= 80 ORDER BY key, d, to_key) n USING (key)", "obj")(lambda p: S.bus_stations(objects_of(p)[0]).select("mode", "key", "osm_id"))


@R.frame("st_city_overrides", "SELECT relation_id, name, name_en FROM (VALUES (CAST(3 AS BIGINT), 'Third', NULL), (4, 'Fourth', 'Fourth in English'), (102, NULL, NULL)) AS t(relation_id, name, name_en)")
def st_city_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.raw(spark, sf_dir)
    return S.city_overrides(raw["boundaries"], raw["overrides"])


R.frame("st_boundary_pieces", f"SELECT relation_id, CAST(5 AS INTEGER) AS points FROM ({duck(A.RECTANGLES)})")(lambda spark, sf_dir: S.boundary_parts(A.boundaries(spark, sf_dir)).select("relation_id", F.size(F.flatten("rings")).alias("points")))
R.frame("st_country_shapes", "SELECT 'FR' AS code, CAST(5 AS INTEGER) AS points")(lambda spark, sf_dir: S.country_shapes(A.raw(spark, sf_dir)["countries"]).select("code", F.size(F.flatten("rings")).alias("points")))


def cut(parts: DataFrame, key: str) -> DataFrame:
    """Outlines in pieces of four corners at most, so that even rectangles, with a point added on each side, are cut."""
    more = F.transform("rings", lambda r: F.flatten(F.transform(geo.segments(r), lambda s: F.array(s["a"], F.struct(((s["a"]["lon"] + s["b"]["lon"]) / 2).alias("lon"), ((s["a"]["lat"] + s["b"]["lat"]) / 2).alias("lat"))))))
    closed = F.transform(more, lambda r: F.concat(r, F.slice(r, 1, 1)))
    pieces = subdivide(parts.select(key, closed.alias("rings")), 7)
    return pieces.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("cut"), F.max(geo.n_points(F.col("rings"))).alias("points"), F.round(F.sum(geo.area(F.col("rings"))), 9).alias("area"))


R.frame("st_cut_boundaries", f"SELECT relation_id, true AS cut, 7 AS points, round(w * h, 9) AS area FROM ({duck(A.RECTANGLES)})")(lambda spark, sf_dir: cut(S.boundary_parts(A.boundaries(spark, sf_dir)), "relation_id"))
R.frame("st_cut_countries", "SELECT 'FR' AS code, true AS cut, 7 AS points, round(CAST(0.4 AS DOUBLE) * CAST(0.3 AS DOUBLE), 9) AS area")(lambda spark, sf_dir: cut(S.country_shapes(A.raw(spark, sf_dir)["countries"]), "code"))


@R.frame("st_fold_column", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM customer")
def st_fold_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_column(load(spark, sf_dir, "customer").withColumnRenamed("c_name", "name")).select("c_custkey", "folded")


OLD_NEW = "SELECT c_custkey AS osm_id, 'N' || c_custkey AS station_key, CAST(c_custkey {0} AS VARCHAR) AS key, CAST('train' AS VARCHAR) AS mode FROM customer WHERE {1}"


@R.frame("st_key_redirects", "SELECT 'train' AS mode, 'K' || o.g AS old_key, 'L' || arg_max(n.g, struct_pack(c := n.c, g := -n.g)) AS new_key FROM (SELECT c_custkey // 10 AS g, c_custkey // 7 AS g2, count(*) AS c FROM customer GROUP BY ALL) o JOIN LATERAL (SELECT o.g2 AS g, o.c AS c) n ON true GROUP BY o.g")
def st_key_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old stations of ten customers each, new ones of seven."""
    c = load(spark, sf_dir, "customer").select(F.lit("train").alias("mode"), F.lit("N").alias("osm_type"), F.col("c_custkey").alias("osm_id"))
    group = lambda n: F.floor(F.col("osm_id") / n).cast("long")
    side = lambda n, p: (c.withColumn("key", group(n).cast("string")), c.select("mode", group(n).cast("string").alias("key")).distinct().withColumn("station_key", F.concat(F.lit(p), F.col("key"))))
    (old_o, old_s), (new_o, new_s) = side(10, "K"), side(7, "L")
    new_s = new_s.withColumn("station_key", F.concat(F.lit("L"), F.lpad("key", 12, "0")))  # so that ties go to the least number
    out = P.key_redirects({"stations": old_s, "objects": old_o, "redirects": spark.createDataFrame([], "mode string, old_key string, new_key string")}, {"stations": new_s, "objects": new_o})
    return out.select("mode", "old_key", F.regexp_replace("new_key", "^L0*(?=[0-9])", "L").alias("new_key"))


@R.frame("st_follow_redirects", "SELECT 'm' AS mode, CASE WHEN o_custkey % 3 = 0 THEN 'k' || o_custkey // 3 * 3 + 1 ELSE 'k' || o_custkey END AS station_key, count(*) AS users FROM orders GROUP BY ALL")
def st_follow_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = run_sql(spark, sf_dir, "SELECT 'm' AS mode, concat('k', o_custkey) AS station_key, count(*) AS users FROM {orders} GROUP BY o_custkey")
    redirects = run_sql(spark, sf_dir, "SELECT DISTINCT 'm' AS mode, concat('k', o_custkey) AS old_key, concat('k', o_custkey + 1) AS new_key FROM {orders} WHERE o_custkey % 3 = 0")
    return P.follow_redirects(usage, redirects)


# --- steps that are read from the whole build
def from_build(name: str, table: str, *columns: str, sql: str | None = None, upto: str = "") -> None:
    R.frame(name, sql and sql_of(sql, upto))(lambda spark, sf_dir: built(spark, sf_dir)[table].selectExpr(*columns))


from_build("st_polish_stops", "stops", "osm_id", "poles", sql="SELECT osm_id, false AS poles FROM st", upto="st")
from_build("st_area_without_stop", "station_objects", "mode", "key", "osm_id", "is_primary", sql="SELECT mode, key, osm_id, is_primary FROM o6", upto="o6")
from_build("st_stations", "stations", "station_id", "mode", "key", "name", "size(objects) AS n_objects", sql="SELECT station_id, mode, key, name, CAST(n_objects AS INTEGER) AS n_objects FROM stn", upto="stn")
R.frame("st_lift_ends", sql_of("SELECT station_id, station_key, lift_end, osm_id FROM stn WHERE osm_type = 'W'", "stn"))(lambda spark, sf_dir: built(spark, sf_dir)["stations"].where("osm_type = 'W'").select("station_id", "station_key", "lift_end", "osm_id"))
from_build("st_station_keys", "stations", "station_id", "station_key", sql="SELECT station_id, station_key FROM stn", upto="stn")
from_build("st_weights", "stations", "station_id", "round(weight, 6) AS weight", sql="SELECT station_id, round(weight + coalesce(2 * ln(1.0 + v.n), 0), 6) AS weight FROM stn LEFT JOIN serves v USING (mode, key)", upto="serves")
from_build(
    "st_country_region_city", "stations", "station_id", "country", "region['name'] AS region", "city['name'] AS city", "city_override", "array_join(boundary_ids, ',') AS boundary_ids",
    sql="SELECT station_id, CASE WHEN lon > 1.9 AND lon < 1.9 + 0.4 AND lat > 48.6 AND lat < 48.6 + 0.3 THEN 'FR' ELSE c END AS country, region, city, city_override, boundary_ids FROM stn LEFT JOIN sited USING (station_id)", upto="sited",
)
from_build("st_settlements", "stations", "station_id", "settlement['name'] AS settlement", "settlement['place'] AS place", sql="SELECT station_id, settlement, place FROM stn LEFT JOIN settled USING (station_id)", upto="settled")
LINES = "SELECT station_id, ref, max(colour) AS colour, round(coalesce(avg(lat) FILTER (WHERE on_track), avg(lat)), 6) AS lat, round(coalesce(avg(lon) FILTER (WHERE on_track), avg(lon)), 6) AS lng FROM called1 GROUP BY station_id, ref"
R.frame("st_station_lines", sql_of(LINES, "called1"))(lambda spark, sf_dir: built(spark, sf_dir)["stations"].selectExpr("station_id", "inline(lines)").withColumns({c: F.round(c, 6) for c in ("lat", "lng")}))
TRACKS = "SELECT station_id, CAST(row_number() OVER (PARTITION BY station_id ORDER BY CAST(ref AS INTEGER)) - 1 AS INTEGER) AS at, ref, round(lat, 6) AS lat, round(lon, 6) AS lng, on_track FROM tracks"
R.frame("st_station_tracks", sql_of(TRACKS, "tracks"))(lambda spark, sf_dir: built(spark, sf_dir)["stations"].selectExpr("station_id", "posexplode(tracks) AS (at, track)").select("station_id", "at", "track.*"))
R.frame("st_lift_lines")(lambda spark, sf_dir: built(spark, sf_dir)["stations"].where("mode in ('aerialway', 'funicular')").select("station_id", "line_name", "lift_end", "ski_area", "lon", "lat"))
from_build("st_latin_names", "stations", "station_id", "latin", sql="SELECT station_id, name AS latin FROM stn", upto="stn")
from_build("st_place_latin", "stations", "station_id", "city['latin'] AS city_latin", sql="SELECT station_id, CAST(NULL AS VARCHAR) AS city_latin FROM stn", upto="stn")
from_build("st_needs_place", "stations", "station_id", "needs_place")
from_build("st_search_names", "station_names", "station_id", "mode", "name", "city_prefixed", "place", "code")


@R.frame("st_platform_stops", sql_of("SELECT station_id, osm_type, osm_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM twin", "twin"))
def st_platform_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = built(spark, sf_dir)
    return S.platform_stops(b["stations"], b["station_objects"]).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@R.frame("st_publish", sql_of("SELECT mode, 'stations' AS t, count(*) AS n FROM stn GROUP BY mode UNION ALL SELECT mode, 'station_objects', count(*) FROM o6 GROUP BY mode", "stn"))
def st_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, root = built(spark, sf_dir), f"{fresh_path(spark, 'live')}-{uuid.uuid4().hex[:4]}"
    P.publish({k: b[k] for k in ("stations", "station_objects", "station_names", "rel_members", "route_stops", "line_routes")}, root)
    live = P.live_tables(spark, root)
    counted = lambda k: live(k).groupBy("mode").agg(F.lit(k).alias("t"), F.count(F.lit(1)).alias("n"))
    return counted("stations").unionByName(counted("station_objects"))


# --- serving
FLAT = ("station_id", "mode", "station_key", "name")
R.frame("q_search")(lambda spark, sf_dir: V.search(tables(spark, sf_dir), "build", lat=48.8, lon=2.1, limit=20).select(*FLAT, "matched", "tier", "score", F.round("distance_km", 6).alias("distance_km")))
R.frame("q_station", sql_of("SELECT station_id, mode, station_key, name FROM stn WHERE mode = 'train' AND station_key = 'N12'", "stn"))(lambda spark, sf_dir: V.station(tables(spark, sf_dir), "train", "gone").select(*FLAT))
R.frame("q_reverse")(lambda spark, sf_dir: V.reverse(tables(spark, sf_dir), 48.8, 2.1, radius_km=3, limit=20).select("station_id", "mode", "name", F.round("distance_m", 3).alias("distance_m")))
R.frame("q_object", sql_of("SELECT DISTINCT station_id, mode, station_key, name FROM stn JOIN (SELECT mode, key FROM o6 WHERE osm_id = 24) USING (mode, key)", "stn"))(lambda spark, sf_dir: V.of_object(tables(spark, sf_dir), "n", 24).select(*FLAT))
R.frame("fn_station_for_object", sql_of("SELECT min(station_id) AS station_id FROM stn JOIN (SELECT mode, key FROM o6 WHERE osm_id = 24 AND mode = 'train') USING (mode, key) HAVING count(*) > 0", "stn"))(lambda spark, sf_dir: V.station_for_object(tables(spark, sf_dir), "N24", "train"))
R.frame("q_nearest")(lambda spark, sf_dir: V.nearest(tables(spark, sf_dir), "bus", [(48.75, 2.1), (48.8, 2.2), (48.85, 2.05)], 2000, 3).select("i", "station_id", F.round("distance_m", 3).alias("distance_m")))
R.frame("q_snap")(lambda spark, sf_dir: V.snap(tables(spark, sf_dir), "tram", [(48.75, 2.1), (48.8, 2.2), (0.0, 0.0)]))


def _some_line(t: V.Tables) -> tuple[str, str, str]:
    """A mode, a station's key and the ref of a line there (the least)."""
    r = t.stations.where("lines is not null and station_key is not null").select("mode", "station_key", F.col("lines")[0]["ref"].alias("ref")).orderBy("mode", "station_key").first()
    return (r["mode"], r["station_key"], r["ref"]) if r else ("train", "none", "none")


@R.frame("q_station_line")
def q_station_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return V.station_line(t, *_some_line(t)).select("relation_id", "name", "colour", F.to_json("stops").alias("stops"))


@R.frame("q_station_services")
def q_station_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    mode, key, _ = _some_line(t)
    return V.station_services(t, mode, key)


@R.frame("q_route")
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    one = t.route_stops.agg(F.min("relation_id")).first()[0] or 0
    return V.route(t, one).select("relation_id", "name", "colour", F.to_json("stops").alias("stops"))


def _some_trip(t: V.Tables) -> tuple[str, list[str], list[str]]:
    """A mode, and the keys and objects of two stations that a route calls at one after the other."""
    ob = t.stations.where("station_key is not null").select("mode", "key", "station_key").join(t.station_objects.select("mode", "key", "osm_type", "osm_id"), ["mode", "key"])
    call = ob.join(t.route_stops, ["osm_type", "osm_id"]).join(t.line_routes.select("relation_id", "mode"), ["relation_id", "mode"]).select("relation_id", "mode", "seq", "station_key", F.concat("osm_type", "osm_id").alias("o"))
    a, b = call.alias("a"), call.alias("b")
    r = a.join(b, ["relation_id", "mode"]).where("a.seq < b.seq and a.station_key <> b.station_key").orderBy("relation_id", "mode", "a.seq", "b.seq").select("mode", F.col("a.station_key"), F.col("b.station_key"), F.col("a.o"), F.col("b.o")).first()
    return (r[0], [r[1], r[2]], [r[3], r[4]]) if r else ("train", ["x", "y"], ["N1", "N2"])


@R.frame("q_directions")
def q_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    mode, keys, _ = _some_trip(t)
    return V.directions(t, mode, [*keys, None, keys[0]])


@R.frame("q_line")
def q_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    mode, _, objects = _some_trip(t)
    return V.line(t, objects[0], objects[1], mode).withColumn("stops", F.to_json("stops"))


@R.frame("fn_variant_stops")
def fn_variant_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, [(0.0, 0.0, False), (0.0, 0.5, True), (0.0, 1.0, False)]), (2, [(0.0, 0.0, True), (0.0, 5.0, False), (0.0, 1.0, True)])]
    return spark.createDataFrame(rows, "id int, points array<struct<lat:double,lng:double,platform:boolean>>").select("id", F.to_json(V.drawn_stretch(F.col("points"))).alias("stops"))


@R.frame("fn_tidy_stops")
def fn_tidy_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, [(0.0, 0.0, "A"), (0.0, 1.0, "B"), (0.0, 2.0, "C"), (0.0, 1.0, "b ")]), (2, [(0.0, 2.0, "C"), (0.0, 0.0, "A"), (0.0, 3.0, "D"), (0.0, 1.0, "B")])]
    return spark.createDataFrame(rows, f"id int, stops array<{V.STOP}>").select("id", F.to_json(V.drawn_order(F.col("stops"))).alias("stops"))


@R.frame("fn_labels")
def fn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_labels(tables(spark, sf_dir).stations, "fr").select("station_id", "label", "city_label", "settlement_label", "region_label")


@R.frame("udf_latin_name")
def udf_latin_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [({"name": "Москва"}, "RU"), ({"name": "Київ"}, "UA"), ({"name": "成都东"}, "CN"), ({"name": "東京", "name:en": "Tokyo"}, "JP"), ({"name": "Gare"}, "FR"), ({"name": "Αθήνα"}, "GR")]
    table = latin.latin_table(spark.createDataFrame(rows, "names map<string,string>, country string"))
    return table.select(F.array_join(F.transform("e", lambda x: x["value"]), "|").alias("names"), "country", "latin")


QUERIES, ORACLES = R.queries, R.oracles
