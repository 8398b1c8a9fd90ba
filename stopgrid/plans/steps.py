"""The steps that turn raw map objects into stations: pure functions of DataFrames, in the order of ``build``.

Raw tables: stops (osm_type, osm_id, tags, lon, lat), rels (relation_id, tags, members), boundaries (relation_id, admin_level, tags,
parts: polygons as rings), line_ways (way_id, kind, name, path), ski_areas (osm_type, osm_id, name, parts), places (node_id, place, tags,
lon, lat), countries (code, parts), overrides (relation_id, admin_level, boundary_name, name, name_en; all strings).

Where an order leaves ties, ids break them, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..functions.maps import map_overlay
from ..operators.graph import components
from ..operators.rel import first_per, update_from
from ..operators.spatial import contains_join, grid_join, line_join, mutual_nearest, near_polygons, nearest_within, within_join
from ..operators.tables import written

# Modes and the route types that are theirs; train services that are no lines; station= values that are no train station.
ROUTE_MODES = (("metro", "subway"), ("metro", "light_rail"), ("metro", "monorail"), ("tram", "tram"), ("tram", "light_rail"), ("train", "train"))
LONG_SERVICES = ("high_speed", "long_distance", "national", "international", "night")
OTHER_STATIONS = ("subway", "light_rail", "monorail", "funicular", "miniature", "tram", "disused", "abandoned", "construction", "proposed")
NAME_KEYS = ("name", "int_name", "alt_name", "official_name", "short_name", "loc_name", "nat_name", "reg_name", "old_name")
NO_CODES = ("no", "none", "yes", "unknown", "нет")
RAIL_MODES = ("train", "metro", "tram", "funicular")
MERGE_M, STRAY_M, BUS_STATION_M, LIFT_END_M, JOINT_M, LIFT_LINE_M, TWIN_M, SKI_M = 400, 400, 80, 60, 5, 60, 10000, 100
REACH = {"city": 8000.0, "town": 4000.0, "village": 2000.0}
OTHER_REACH, NAMED_AFTER_M, PLATFORM_M, PLATFORM_RATIO = 800.0, 3000, 30, 1.5


def tag(k: str, of: str = "tags") -> Column:
    return F.col(of)[k]


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has(k: str, of: str = "tags") -> Column:
    return F.map_contains_key(F.col(of), k)


def has_name_first() -> Column:
    return has("name").desc()


def area_id(key: str = "key") -> Column:
    """The stop area group in a key, or null."""
    return F.when(F.col(key).startswith("A"), F.try_to_number(F.substring(F.col(key), 2, 30), F.lit("9" * 18)).cast("long"))


def is_primary_stop(tags: str = "tags") -> Column:
    t = lambda k: tag(k, tags)
    kind = t("railway").isin("station", "halt", "tram_stop") | (t("highway") == "bus_stop") | t("amenity").isin("bus_station", "ferry_terminal") | (t("aerialway") == "station") | (t("public_transport") == "station")
    return true(kind) & ~true(T.is_quay_code(t("name")))


def clean_name(name: Column, ref: Column, poles: Column) -> Column:
    return T.without_quay(T.without_pole(name, ref, poles))


# --- objects


def polish_stops(stops: DataFrame, countries: DataFrame) -> DataFrame:
    """stops with poles: whether names of stops there end in their pole. The box goes first, as a plain range filter."""
    poland = countries.where("code = 'PL'").select(F.explode("parts").alias("rings"))
    boxed = stops.where("lon between 14 and 24.5 and lat between 48.9 and 55").select("osm_type", "osm_id", "lon", "lat")
    inside = contains_join(boxed, poland, 1.0, border=True).select("osm_type", "osm_id").distinct().withColumn("poles", F.lit(True))
    return stops.join(inside, ["osm_type", "osm_id"], "left").withColumn("poles", true(F.col("poles")))


def rel_members(rels: DataFrame) -> DataFrame:
    rows = rels.select("relation_id", (tag("public_transport") == "stop_area").alias("is_stop_area"), tag("route").alias("route"), F.posexplode("members").alias("p", "m"))
    return rows.select("relation_id", "is_stop_area", "route", F.col("m.type").alias("osm_type"), F.col("m.ref").alias("osm_id"), F.col("m.role").alias("role"), (F.col("p") + 1).alias("seq"))


def route_stops(members: DataFrame) -> DataFrame:
    is_stop = true(F.col("role").startswith("stop"))
    marked = members.where("route is not null").withColumn("_any", F.max(is_stop).over(Window.partitionBy("relation_id")))
    return marked.where(is_stop | ~F.col("_any")).select("relation_id", "seq", "osm_type", "osm_id")


def route_calls(rels: DataFrame) -> DataFrame:
    """route_stops with each call's route, read off the relations' own member lists, so nothing is shuffled."""
    numbered = F.transform("members", lambda m, i: F.struct((i + 1).alias("seq"), m["type"].alias("osm_type"), m["ref"].alias("osm_id"), m["role"].alias("role")))
    rows = rels.where(tag("route").isNotNull()).select("relation_id", tag("route").alias("route"), numbered.alias("all"))
    rows = rows.withColumn("stops", F.filter("all", lambda m: true(m["role"].startswith("stop"))))
    called = rows.select("relation_id", "route", F.inline(F.when(F.size("stops") > 0, F.col("stops")).otherwise(F.col("all"))))
    return called.select("relation_id", "seq", "osm_type", "osm_id", "route")


def line_calls(rels: DataFrame) -> DataFrame:
    """relation_id, mode, ref, colour, osm_type, osm_id of every member of a line's relation."""
    held = line_routes(rels, "members").select("relation_id", "mode", tag("ref").alias("ref"), tag("colour").alias("colour"), F.explode("members").alias("m"))
    return held.select("relation_id", "mode", "ref", "colour", F.col("m.type").alias("osm_type"), F.col("m.ref").alias("osm_id"))


def _modes(rels: DataFrame) -> DataFrame:
    return rels.sparkSession.createDataFrame(ROUTE_MODES, "mode string, route string")


def line_routes(rels: DataFrame, *more: str) -> DataFrame:
    rows = rels.withColumn("route", tag("route")).join(F.broadcast(_modes(rels)), "route")
    service = tag("ref").rlike("[0-9]{3}") | F.coalesce(tag("service"), F.lit("")).isin(*LONG_SERVICES)
    return rows.where(tag("ref").isNotNull() & ((F.col("mode") != "train") | ~service)).select("relation_id", "mode", "tags", *more)


def area_group(members: DataFrame, stops: DataFrame) -> DataFrame:
    """relation_id, group_id of every stop area: those that share a primary stop are one group, through chains."""
    areas = members.where("is_stop_area").select("relation_id", "osm_type", "osm_id")
    primary = stops.where(is_primary_stop()).select("osm_type", "osm_id")
    shared = areas.join(primary, ["osm_type", "osm_id"]).groupBy("osm_type", "osm_id", "relation_id").agg(F.lit(1).alias("_"))
    hub = shared.groupBy("osm_type", "osm_id").agg(F.min("relation_id").alias("u"))  # a star for each stop, not all its pairs
    labels = components(shared.join(hub, ["osm_type", "osm_id"]).select("u", F.col("relation_id").alias("v")))
    return areas.select("relation_id").distinct().join(labels.withColumnRenamed("node", "relation_id"), "relation_id", "left").select("relation_id", F.coalesce("label", "relation_id").alias("group_id"))


def stop_modes(stops: DataFrame) -> DataFrame:
    yes = lambda *ks: _any(*(tag(k) == "yes" for k in ks))
    listed = F.split(F.regexp_replace(F.coalesce(tag("station"), F.lit("")), r"[\t\n\f\r ]", ""), ";")
    plain_train = tag("railway").isin("station", "halt") & (true(tag("station").rlike(r"(^|;)[\t\n\f\r ]*train[\t\n\f\r ]*(\z|;)")) | ~F.arrays_overlap(listed, F.array(*map(F.lit, OTHER_STATIONS))))
    modes = {
        "train": _any(plain_train, (tag("train") == "yes") & ~F.coalesce(tag("station"), F.lit("")).isin("subway", "monorail")),
        "metro": _any(tag("station").isin("subway", "light_rail", "monorail"), yes("subway", "light_rail", "monorail")),
        "tram": _any(tag("railway") == "tram_stop", tag("station") == "light_rail", yes("tram", "light_rail")),
        "bus": _any(tag("highway") == "bus_stop", tag("amenity") == "bus_station", yes("bus")),
        "ferry": _any(tag("amenity") == "ferry_terminal", yes("ferry")),
        "funicular": _any(tag("station") == "funicular", yes("funicular")),
        "aerialway": true(tag("aerialway") == "station"),
    }
    held = F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in modes.items())))
    return stops.select("osm_type", "osm_id", F.explode(held).alias("mode"))


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | true(c)
    return out


OBJECT = ["mode", "key", "osm_type", "osm_id", "tags", "lon", "lat", "is_primary", "source_key", "poles"]


def station_objects(stops: DataFrame, modes: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    area = members.join(groups, "relation_id").groupBy("osm_type", "osm_id").agg(F.min("group_id").alias("group_id"))
    rows = modes.join(stops, ["osm_type", "osm_id"]).join(area, ["osm_type", "osm_id"], "left")
    key = F.coalesce(F.concat(F.lit("A"), F.col("group_id")), F.concat(F.lit("Q"), tag("wikidata")), F.concat("osm_type", "osm_id"))
    return rows.withColumn("key", key).withColumn("source_key", F.col("key")).withColumn("is_primary", is_primary_stop()).select(*OBJECT)


def shared_metro(objects: DataFrame, modes: DataFrame) -> DataFrame:
    """objects with, as trains, primary metro stations that trains serve: their group has train stop positions that no metro has, and no train station."""
    train = objects.where("mode = 'train'")
    metro_ids = modes.where("mode = 'metro'").select("osm_type", "osm_id")
    calls = train.where(tag("public_transport") == "stop_position").join(metro_ids, ["osm_type", "osm_id"], "left_anti").select("key").distinct()
    own = train.where("is_primary").select("key").distinct()
    found = objects.where((F.col("mode") == "metro") & F.col("is_primary") & (tag("train") == "yes")).join(calls, "key", "left_semi").join(own, "key", "left_anti")
    return objects.unionByName(found.withColumn("mode", F.lit("train")).withColumn("is_primary", F.lit(True)).select(*OBJECT))


def untagged_positions(objects: DataFrame, stops: DataFrame, modes: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """objects with the stop areas' members that say no mode, in every mode of their group; entrances are none."""
    areas = objects.where(F.col("key").startswith("A")).select("mode", "key").distinct().withColumn("group_id", area_id())
    ids = areas.join(groups, "group_id").join(members.select("relation_id", "osm_type", "osm_id"), "relation_id").select("mode", "key", "osm_type", "osm_id").distinct()
    quiet = ids.join(modes.select("osm_type", "osm_id").distinct(), ["osm_type", "osm_id"], "left_anti")
    entrance = F.coalesce(tag("railway"), F.lit("")).isin("subway_entrance", "train_station_entrance") | has("entrance")
    rows = quiet.join(stops.where(~entrance), ["osm_type", "osm_id"])
    return objects.unionByName(rows.withColumn("is_primary", F.lit(False)).withColumn("source_key", F.col("key")).select(*OBJECT))


def areas_without_stop(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """objects in which a named area of poles without a primary object of a mode gets one: a platform first, then a named one."""
    named = rels.where(tag("name").isNotNull()).select(F.col("relation_id").alias("_area"))
    have = objects.where("is_primary").select("mode", "key").distinct()
    lone = objects.where("poles").withColumn("_area", area_id()).join(named, "_area", "left_semi").join(have, ["mode", "key"], "left_anti")
    ids = ["mode", "key", "osm_type", "osm_id"]
    chosen = first_per(lone, ["mode", "key"], [true(tag("public_transport") == "platform").desc(), has_name_first(), F.col("osm_type"), F.col("osm_id")])
    return update_from(objects, chosen.select(*ids, F.lit(True).alias("is_primary")), ids, ["is_primary"])


# --- groups


def named_groups(objects: DataFrame, rels: DataFrame) -> DataFrame:
    """mode, key, name (bare), x, y of each group with a primary object and a name."""
    areas = rels.select(F.col("relation_id").alias("_area"), tag("name").alias("_area_name"))
    rep = first_per(objects.where("is_primary"), ["mode", "key"], [has_name_first(), F.col("osm_type"), F.col("osm_id")])
    rows = rep.withColumn("_area", area_id()).join(areas, "_area", "left")
    bare = T.without_line(clean_name(F.coalesce(tag("name"), F.col("_area_name")), tag("ref"), F.col("poles")))
    x, y = geo.equirect(F.col("lon"), F.col("lat"))
    return rows.select("mode", "key", T.search_fold(T.town_stripped(bare)).alias("name"), x.alias("x"), y.alias("y")).where("name <> ''")


def near_duplicates(named: DataFrame) -> DataFrame:
    """mode, a, b: groups of one mode and name within 400 m. The names, which both sides read, are folded once."""
    named = written(named, "named")
    return grid_join(named, named, ["mode", "name"], "x", "y", float(MERGE_M)).where("key < key_r").select("mode", F.col("key").alias("a"), F.col("key_r").alias("b"))


def merge_groups(objects: DataFrame, pairs: DataFrame) -> DataFrame:
    """objects with each chain of near duplicates under its least key."""
    node = lambda c: F.concat("mode", F.lit("\x01"), c)
    labels = components(pairs.select(node("a").alias("u"), node("b").alias("v")))
    part = lambda c, i: F.split(c, "\x01").getItem(i)
    changes = labels.select(part("node", 0).alias("mode"), part("node", 1).alias("key"), part("label", 1).alias("_to"))
    out = objects.join(changes, ["mode", "key"], "left")
    return out.withColumn("key", F.coalesce("_to", "key")).select(*OBJECT)


def _rekey(objects: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: mode, key, to."""
    return objects.join(moves, ["mode", "key"], "left").withColumn("key", F.coalesce("to", "key")).select(*OBJECT)


def attach_strays(objects: DataFrame) -> DataFrame:
    """objects with groups that have no primary object under the nearest station of their mode within 400 m of one of their objects."""
    have = objects.where("is_primary").select("mode", "key").distinct()
    strays = first_per(objects.join(have, ["mode", "key"], "left_anti"), ["mode", "key"], [F.col("osm_type"), F.col("osm_id")]).select("mode", "key", "lon", "lat")
    stations = objects.where("is_primary").select("mode", F.col("key").alias("to"), "lon", "lat")
    near = nearest_within(strays, stations, STRAY_M, ["mode", "key"], ["to_r"], ["mode"])
    return _rekey(objects, near.select("mode", "key", F.col("to_r").alias("to")))


def bus_stations(objects: DataFrame) -> DataFrame:
    """objects with bus stops' groups under the nearest bus station within 80 m."""
    bus = objects.where("mode = 'bus' and is_primary")
    halls = first_per(bus.where(tag("amenity") == "bus_station"), ["key"], [F.col("osm_type"), F.col("osm_id")]).select("mode", F.col("key").alias("to"), "lon", "lat")
    others = bus.join(halls.select(F.col("to").alias("key")), "key", "left_anti").select("mode", "key", "lon", "lat")
    near = within_join(others, halls, BUS_STATION_M, ["mode"])
    return _rekey(objects, first_per(near, ["mode", "key"], [F.col("d"), F.col("to_r")]).select("mode", "key", F.col("to_r").alias("to")))


# --- stations


def stations(objects: DataFrame, rels: DataFrame, groups: DataFrame) -> DataFrame:
    plain = (~tag("name").eqNullSafe(T.without_line(tag("name")))).asc()
    rep = first_per(objects.where("is_primary"), ["mode", "key"], [true(tag("amenity") == "bus_station").desc(), has_name_first(), plain, F.col("osm_type"), F.col("osm_id")])
    ref = lambda t, i: F.struct(F.col(t).alias("type") if t in ("osm_type",) else F.lit(t).alias("type"), F.col(i).alias("id"))
    grouped = objects.groupBy("mode", "key").agg(F.collect_list(ref("osm_type", "osm_id")).alias("_objects"), F.max(tag("wikidata")).alias("wikidata"), F.max(tag("uic_ref")).alias("uic_ref"), (F.countDistinct("source_key") > 1).alias("_merged"))
    sources = objects.where(F.col("source_key").startswith("A")).select("mode", "key", area_id("source_key").alias("group_id")).distinct()
    areas = sources.join(groups, "group_id").groupBy("mode", "key").agg(F.collect_set(ref("R", "relation_id")).alias("_areas"))
    area = rels.select(F.col("relation_id").alias("_area"), F.col("tags").alias("_area_tags"))
    rows = rep.withColumn("_area", area_id()).join(grouped, ["mode", "key"]).join(areas, ["mode", "key"], "left").join(area, "_area", "left")
    name = F.coalesce(tag("name"), tag("name", "_area_tags"))
    cleaned = clean_name(name, tag("ref"), F.col("poles"))
    kept = F.map_filter(map_overlay(F.col("_area_tags"), F.col("tags")), lambda k, v: k.rlike(r"^name:[a-z]{2,3}(?:[-_][A-Za-z]{2,4})?\z") | k.isin(*NAME_KEYS))
    names = F.transform_values(kept, lambda k, v: clean_name(v, tag("ref"), F.col("poles")))
    both = F.array_sort(F.concat("_objects", F.coalesce("_areas", F.expr("cast(array() as array<struct<type:string,id:bigint>>)"))))
    out = rows.where(name.isNotNull()).select(
        "mode", "key", "osm_type", "osm_id", F.when(F.col("_merged"), T.without_line(cleaned)).otherwise(cleaned).alias("name"), names.alias("names"), "wikidata", "uic_ref", "lon", "lat", both.alias("objects"),
        (F.log(1.0 + F.size(both)) + F.when(F.col("wikidata").isNotNull(), 0.5).otherwise(0.0)).alias("weight"),
        F.lit(None).cast("string").alias("station_key"), F.lit(None).cast("string").alias("line_name"), F.lit(None).cast("string").alias("lift_end"),
    )
    from ..queries_relational import dense_ids

    return dense_ids(out, ["mode", "key"], "station_id")


def lift_ends(st: DataFrame, objects: DataFrame, line_ways: DataFrame) -> DataFrame:
    """st with a station at each end of a named aerialway that has none there and doesn't go on as another way."""
    ends = line_ways.where("kind = 'aerialway'").select("way_id", "name", F.explode(F.array(F.struct(F.lit("lower").alias("end"), geo.start_point(F.col("path")).alias("p")), F.struct(F.lit("upper").alias("end"), geo.end_point(F.col("path")).alias("p")))).alias("e"))
    ends = ends.select("way_id", "name", F.col("e.end").alias("lift_end"), F.col("e.p.lon").alias("lon"), F.col("e.p.lat").alias("lat"))
    named = objects.where((F.col("mode") == "aerialway") & F.col("is_primary") & has("name")).select("lon", "lat")
    taken = within_join(ends, named, LIFT_END_M).select("way_id", "lift_end").distinct()
    others = line_ways.where("kind = 'aerialway'").select("way_id", F.col("name").alias("other_name"), "path")
    joints = line_join(ends.withColumnRenamed("way_id", "own_id"), others, JOINT_M).where("way_id <> own_id and other_name = name").select(F.col("own_id").alias("way_id"), "lift_end").distinct()
    free = ends.join(taken, ["way_id", "lift_end"], "left_anti").join(joints, ["way_id", "lift_end"], "left_anti")
    top = st.agg(F.coalesce(F.max("station_id"), F.lit(0)).alias("_top"))
    from ..queries_relational import dense_ids

    numbered = dense_ids(free, ["way_id", "lift_end"], "_n").crossJoin(F.broadcast(top))
    rows = numbered.select(
        (F.col("_top") + F.col("_n")).cast("int").alias("station_id"), F.lit("aerialway").alias("mode"), F.concat(F.lit("L"), "way_id", "lift_end").alias("key"), F.lit("W").alias("osm_type"), F.col("way_id").alias("osm_id"), "name",
        F.create_map(F.lit("name"), "name").alias("names"), F.lit(None).cast("string").alias("wikidata"), F.lit(None).cast("string").alias("uic_ref"), "lon", "lat", F.array(F.struct(F.lit("W").alias("type"), F.col("way_id").alias("id"))).alias("objects"),
        F.log(F.lit(2.0)).alias("weight"), F.concat(F.lit("W"), "way_id", F.lit(":"), "lift_end").alias("station_key"), F.col("name").alias("line_name"), "lift_end",
    )
    return st.unionByName(rows)


def station_keys(st: DataFrame) -> DataFrame:
    """st with station_key: the first of wikidata, UIC code and object that no other station of the mode could have."""
    choices = F.array(
        F.struct(F.lit(1).alias("priority"), F.when(F.col("wikidata").rlike(r"^Q[0-9]+\z"), F.col("wikidata")).alias("choice")),
        F.struct(F.lit(2).alias("priority"), F.concat(F.lit("UIC"), F.nullif(F.trim("uic_ref"), F.lit(""))).alias("choice")),
        F.struct(F.lit(3).alias("priority"), F.concat("osm_type", "osm_id").alias("choice")),
    )
    rows = st.where("station_key is null").select("station_id", "mode", F.inline(choices)).where("choice is not null")
    rows = rows.withColumn("_holders", F.count(F.lit(1)).over(Window.partitionBy("mode", "choice"))).where("_holders = 1")
    best = rows.groupBy("station_id").agg(F.min_by("choice", "priority").alias("station_key"))
    return update_from(st, best, ["station_id"], ["station_key"])


def weights(st: DataFrame, calls: DataFrame, rels: DataFrame, objects: DataFrame) -> DataFrame:
    """calls: route_calls, or route_stops, whose routes are looked up."""
    routed = calls if "route" in calls.columns else calls.join(rels.select("relation_id", tag("route").alias("route")), "relation_id")
    served = routed.join(F.broadcast(_modes(rels)), "route").join(objects.select("mode", "key", "osm_type", "osm_id"), ["mode", "osm_type", "osm_id"])
    n = served.groupBy("mode", "key").agg(F.countDistinct("relation_id").alias("_routes"))
    return st.join(n, ["mode", "key"], "left").withColumn("weight", F.col("weight") + F.when(F.col("_routes").isNotNull(), 2 * F.log(1.0 + F.col("_routes"))).otherwise(0.0)).drop("_routes").select(*st.columns)


# --- places


def boundary_parts(boundaries: DataFrame) -> DataFrame:
    return boundaries.select("relation_id", F.explode("parts").alias("rings"))


def city_overrides(boundaries: DataFrame, overrides: DataFrame) -> DataFrame:
    """relation_id, name, name_en: boundaries that are the city of what is inside, listed by id, or by level and name, or known by their tags."""
    b = boundaries.select("relation_id", "admin_level", tag("name").alias("_name"), tag("place").alias("_place"))
    p = overrides.select(F.expr("try_cast(relation_id as bigint)").alias("_id"), F.col("relation_id").isNull().alias("_by_name"), F.expr("try_cast(admin_level as int)").alias("_level"), "boundary_name", F.nullif("name", F.lit("")).alias("name"), F.nullif("name_en", F.lit("")).alias("name_en"))
    by_id = b.join(F.broadcast(p), F.col("relation_id") == F.col("_id"))
    by_name = b.join(F.broadcast(p.where("_by_name")), (F.col("admin_level") == F.col("_level")) & (F.col("_name") == F.col("boundary_name")))
    listed = first_per(by_id.unionByName(by_name), ["relation_id"], [F.col("name"), F.col("name_en")]).select("relation_id", "name", "name_en")
    known = b.where("(admin_level between 4 and 7 and _place = 'city') or (admin_level = 5 and endswith(_name, '市'))").join(listed, "relation_id", "left_anti")
    return listed.unionByName(known.select("relation_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("name_en")))


def country_shapes(countries: DataFrame) -> DataFrame:
    return countries.select("code", F.explode("parts").alias("rings"))


def country_region_city(st: DataFrame, boundaries: DataFrame, overrides: DataFrame, countries: DataFrame) -> DataFrame:
    """st with country, region, city, city_override and boundary_ids."""
    co = overrides.select("relation_id", F.col("name").alias("_n"), F.col("name_en").alias("_e"), F.lit(True).alias("_city"))
    extra = F.map_filter(F.create_map(F.lit("name"), F.col("_n"), F.lit("name:en"), F.coalesce("_e", "_n")), lambda k, v: v.isNotNull())
    b = boundaries.select("relation_id", "admin_level", "tags").join(co, "relation_id", "left").select(
        "relation_id", "admin_level", true(F.col("_city")).alias("is_city"), F.upper(tag("ISO3166-1:alpha2")).alias("c"), F.upper(F.left(tag("ISO3166-2"), F.lit(2))).alias("rc"),
        T.place_tags(F.col("tags")).alias("place"), T.place_tags(map_overlay(F.col("tags"), extra)).alias("city_place"),
    )
    hits = contains_join(st.select("station_id", "lon", "lat"), boundary_parts(boundaries)).select("station_id", "relation_id").distinct()
    rows = hits.join(b, "relation_id")
    deep = F.struct("admin_level", F.col("relation_id"))
    level = F.col("admin_level")
    agg = rows.groupBy("station_id").agg(
        F.max(F.when(level == 2, F.col("c"))).alias("_c"), F.max(F.when(level == 4, F.col("rc"))).alias("_rc"),
        F.min_by(F.when(level == 4, F.col("place")), F.when(level == 4, F.col("relation_id"))).alias("region"),
        F.max_by("city_place", F.when(F.col("is_city"), deep)).alias("_over"), F.max_by("place", F.when(level.between(6, 8), deep)).alias("_muni"),
        F.bool_or("is_city").alias("city_override"), F.bool_or(level.between(6, 8)).alias("_has_muni"),
        F.array_sort(F.collect_set(F.when(level.between(4, 8) | F.col("is_city"), F.col("relation_id")))).alias("boundary_ids"),
    )
    agg = agg.withColumn("city", F.when(F.col("city_override"), F.col("_over")).when(F.col("_has_muni"), F.col("_muni")))
    codes = contains_join(st.select("station_id", "lon", "lat"), country_shapes(countries), 1.0).groupBy("station_id").agg(F.min("code").alias("_code"))
    out = st.join(agg, "station_id", "left").join(codes, "station_id", "left")
    return out.withColumn("country", F.coalesce("_code", "_c", "_rc")).drop("_c", "_rc", "_over", "_muni", "_has_muni", "_code")


def settlements(st: DataFrame, places: DataFrame, boundaries: DataFrame) -> DataFrame:
    """st with settlement: a place within its kind's reach, in the station's own municipality where it has one; a city first, then the nearest for its reach."""
    muni = boundaries.where("admin_level between 6 and 8").select("relation_id", "admin_level")
    of_place = contains_join(places.select("node_id", "lon", "lat"), boundary_parts(boundaries).join(muni, "relation_id", "left_semi")).select("node_id", "relation_id").distinct()
    of_station = st.select("station_id", F.explode("boundary_ids").alias("relation_id")).join(muni, "relation_id").groupBy("station_id").agg(F.max_by("relation_id", F.struct("admin_level", "relation_id")).alias("muni"))
    # a place meets the stations of its municipalities, and those of none; of each kind only the nearest is asked for
    here = st.where(~F.col("country").eqNullSafe(F.lit("CN"))).select("station_id", "lon", "lat").join(of_station, "station_id", "left")
    here = written(here.select("station_id", "lon", "lat", F.coalesce(F.col("muni").cast("string"), F.lit("")).alias("in")), "sited")
    there = places.select("node_id", "place", "tags", "lon", "lat")
    inside = there.join(of_place, "node_id").withColumn("in", F.col("relation_id").cast("string")).drop("relation_id")
    there = written(there.withColumn("in", F.lit("")).unionByName(inside), "places")
    kind = F.when(F.col("place").isin(*REACH), F.col("place")).otherwise("")
    of_kind = [nearest_within(here, there.where(kind == k), far, ["station_id"], ["node_id_r"], ["in"]).withColumn("reach", F.col("d") / far) for k, far in [*REACH.items(), ("", OTHER_REACH)]]
    near = of_kind[0].unionByName(of_kind[1]).unionByName(of_kind[2]).unionByName(of_kind[3])
    best = first_per(near, ["station_id"], [(F.col("place_r") == "city").desc(), F.col("reach"), F.col("node_id_r")])
    best = best.select("station_id", map_overlay(T.place_tags(F.col("tags_r")), F.create_map(F.lit("place"), F.col("place_r"))).alias("settlement"))
    return st.join(best, "station_id", "left")


# --- lines and tracks


def station_lines(st: DataFrame, objects: DataFrame, calls: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """st with lines: [ref, colour, lat, lng], at the middle of a line's stop positions, else of its other objects there. calls: line_calls, or
    relations' members with the lines' relations."""
    if lines is not None:
        calls = calls.join(lines.select("relation_id", "mode", tag("ref").alias("ref"), tag("colour").alias("colour")), "relation_id")
    on = true(tag("public_transport") == "stop_position").alias("on")
    ids = st.select("station_id", "mode", "key").join(objects.select("mode", "key", "osm_type", "osm_id", on, "lon", "lat"), ["mode", "key"])
    rows = ids.join(calls.select("mode", "ref", "colour", "osm_type", "osm_id"), ["mode", "osm_type", "osm_id"])
    one = rows.groupBy("station_id", "ref", "osm_type", "osm_id").agg(F.max("colour").alias("colour"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.bool_or("on").alias("on"))
    middle = lambda c: F.coalesce(F.avg(F.when(F.col("on"), F.col(c))), F.avg(c))
    points = one.groupBy("station_id", "ref").agg(F.max("colour").alias("colour"), middle("lat").alias("lat"), middle("lon").alias("lng"))
    listed = points.groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct(F.length("ref").alias("n"), "ref", "colour", "lat", "lng"))).alias("l"))
    listed = listed.select("station_id", F.transform("l", lambda x: F.struct(x["ref"].alias("ref"), x["colour"].alias("colour"), x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("lines"))
    return st.join(listed, "station_id", "left")


def of_stations(st: DataFrame, objects: DataFrame) -> DataFrame:
    return st.select("station_id", "mode", "key", F.col("lon").alias("st_lon"), F.col("lat").alias("st_lat")).join(objects, ["mode", "key"])


def platform_stops(st: DataFrame, objects: DataFrame) -> DataFrame:
    """station_id, osm_type, osm_id of a platform of one track, and lon, lat of the unnumbered stop position that is surely its own."""
    rows = of_stations(st, objects).where(F.col("mode").isin(*RAIL_MODES)).withColumn("id", F.struct("osm_type", "osm_id"))
    one = F.coalesce(tag("railway:track_ref"), tag("local_ref"), tag("ref")).rlike(r"^[^;]+\z")
    platforms = rows.where(_any(tag("public_transport") == "platform", tag("railway") == "platform") & one).select("station_id", F.col("id").alias("a"), "lon", "lat")
    numbered = has("railway:track_ref") | has("local_ref") | has("ref")
    positions = rows.where(true(tag("public_transport") == "stop_position") & ~numbered).select("station_id", F.col("id").alias("b"), "lon", "lat")
    met = mutual_nearest(platforms, positions, "station_id", "a", "b", PLATFORM_M, PLATFORM_RATIO)
    return met.select("station_id", "a.osm_type", "a.osm_id", F.col("lon_r").alias("lon"), F.col("lat_r").alias("lat"))


def station_tracks(st: DataFrame, objects: DataFrame, own: DataFrame) -> DataFrame:
    """st with tracks: [ref, lat, lng, on_track], the plain numbers first."""
    rows = of_stations(st, objects).where(F.col("mode").isin(*RAIL_MODES, "bus", "ferry"))
    rows = rows.where(_any(tag("public_transport").isin("stop_position", "platform"), tag("railway") == "platform", tag("highway") == "bus_stop"))
    rows = rows.join(own.select("station_id", "osm_type", "osm_id", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")), ["station_id", "osm_type", "osm_id"], "left")
    refs = F.coalesce(tag("railway:track_ref"), tag("local_ref"), T.quay_code(tag("name")), T.quay_of(tag("name")), T.pole_of(tag("name"), F.col("poles")), F.when(~F.col("mode").isin("bus", "ferry"), tag("ref")))
    on = true(tag("public_transport") == "stop_position") | F.col("p_lon").isNotNull()
    rows = rows.select("station_id", "st_lon", "st_lat", F.coalesce("p_lon", "lon").alias("lon"), F.coalesce("p_lat", "lat").alias("lat"), on.alias("on_track"), F.explode(F.split(refs, ";")).alias("part"))
    rows = rows.withColumn("ref", T.track_ref(F.col("part"))).where(T.is_track(F.col("ref")))
    far = geo.planar(F.col("lon"), F.col("lat"), F.col("st_lon"), F.col("st_lat"))
    best = first_per(rows, ["station_id", "ref"], [F.col("on_track").desc(), far, F.col("lon"), F.col("lat")])
    word = F.lower(F.split_part(F.col("ref"), F.lit(" "), F.lit(2)))
    number = F.expr("try_cast(nullif(regexp_extract(ref, '^[0-9]+', 0), '') as int)")
    order = F.struct(F.when(word.isin("bis", "ter", "quater"), "").otherwise(word).alias("part"), number.isNull().alias("last"), number.alias("n"), "ref", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lng"), "on_track")
    listed = best.groupBy("station_id").agg(F.array_sort(F.collect_list(order)).alias("t"))
    return st.join(listed.select("station_id", F.transform("t", lambda x: F.struct(x["ref"].alias("ref"), x["lat"].alias("lat"), x["lng"].alias("lng"), x["on_track"].alias("on_track"))).alias("tracks")), "station_id", "left")


def lift_lines(st: DataFrame, line_ways: DataFrame, ski_areas: DataFrame) -> DataFrame:
    """st of lifts and funiculars with line_name, lift_end, their place on the line, and ski_area, each change seen by the next."""
    lifts = st.where("mode in ('aerialway', 'funicular')")
    met = line_join(lifts.select("station_id", "mode", "lon", "lat"), line_ways.select("way_id", "kind", F.col("name").alias("way_name"), "path"), LIFT_LINE_M).where("kind = mode")
    met = written(met.select("station_id", "way_id", "kind", "way_name", "path", "d", "near"), "lifts-met")  # each change below reads it
    single = met.groupBy("station_id").agg(F.min("way_name").alias("line_name"), F.countDistinct("way_name").alias("n")).where("n = 1").drop("n")
    st = update_from(st, single, ["station_id"], ["line_name"])
    alike = met.join(st.where("line_name is null").select("station_id", "name"), "station_id").where(T.search_fold(F.col("way_name")) == T.search_fold(F.col("name")))
    st = update_from(st, first_per(alike, ["station_id"], [F.col("d"), F.col("way_id")]).select("station_id", F.col("way_name").alias("line_name")), ["station_id"], ["line_name"])
    st = written(st, "lifts-named")
    own = met.join(st.select("station_id", "mode", "name", "line_name", "lift_end", "lon", "lat"), "station_id").where("way_name = line_name")
    lift = st.where("mode = 'aerialway' and line_name is not null").select("station_id", "line_name", T.search_fold(F.col("name")).alias("folded"), "lon", "lat")
    twins = within_join(lift, lift.withColumnRenamed("station_id", "twin"), TWIN_M, ["line_name", "folded"]).where("twin_r <> station_id").select("station_id").distinct().withColumn("_twin", F.lit(True))
    added = st.where("mode = 'aerialway' and osm_type = 'W' and lift_end is not null").select(F.col("osm_id").alias("way_id")).distinct().withColumn("_added", F.lit(True))
    ends = own.where("kind = 'aerialway' and mode = 'aerialway' and lift_end is null").join(twins, "station_id", "left").join(added, "way_id", "left")
    ends = ends.where(true(F.col("_twin")) | (true(F.col("_added")) & (T.search_fold(F.col("name")) == T.search_fold(F.col("line_name")))))
    a, b = geo.start_point(F.col("path")), geo.end_point(F.col("path"))
    lower = geo.planar(F.col("lon"), F.col("lat"), a["lon"], a["lat"]) <= geo.planar(F.col("lon"), F.col("lat"), b["lon"], b["lat"])
    by = [F.col("d"), F.col("way_id")]
    st = update_from(st, first_per(ends, ["station_id"], by).select("station_id", F.when(lower, "lower").otherwise("upper").alias("lift_end")), ["station_id"], ["lift_end"])
    st = update_from(st, first_per(own, ["station_id"], by).select("station_id", F.col("near.lon").alias("lon"), F.col("near.lat").alias("lat")), ["station_id"], ["lon", "lat"])
    ski = ski_areas.select(F.col("osm_id").alias("ski_id"), F.col("name").alias("ski_name"), F.explode("parts").alias("rings")).withColumn("size", geo.area(F.col("rings")))
    middle = own.withColumn("m", geo.interpolate(F.col("path"), 0.5)).select("station_id", F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"))
    smallest = [F.col("size"), F.col("ski_id")]
    inside = first_per(contains_join(middle, ski), ["station_id"], smallest).select("station_id", F.col("ski_name").alias("ski_area"))
    beside = first_per(near_polygons(st.where("mode in ('aerialway', 'funicular') and line_name is null").select("station_id", "lon", "lat"), ski, SKI_M), ["station_id"], smallest).select("station_id", F.col("ski_name").alias("ski_area"))
    return st.join(inside.unionByName(beside), "station_id", "left")


# --- names


def boundary_names(boundaries: DataFrame, overrides: DataFrame) -> DataFrame:
    co = overrides.select("relation_id", F.col("name").alias("_n"), F.col("name_en").alias("_e"), F.lit(True).alias("_city"))
    extra = F.map_filter(F.create_map(F.lit("override"), F.col("_n"), F.lit("override:en"), F.col("_e")), lambda k, v: v.isNotNull())
    rows = boundaries.select("relation_id", "admin_level", "tags").join(co, "relation_id", "left").where("admin_level between 4 and 8 or _city")
    rows = rows.select("relation_id", F.explode(map_overlay(F.col("tags"), extra)).alias("k", "v"))
    rows = rows.where((F.col("k") == "name") | F.col("k").rlike(r"^name:[a-z]{2,3}\z") | F.col("k").startswith("override") | F.col("k").isin("int_name", "alt_name", "official_name", "short_name"))
    cut = rows.select("relation_id", F.explode(F.split("v", rf"{T.SPACE}+-{T.SPACE}+|{T.SPACE}*/{T.SPACE}*|;")).alias("part"))
    full = cut.select("relation_id", T.search_fold(F.trim("part")).alias("full"))
    short = F.when(~F.col("full").rlike("[ a-z]") & (F.length("full") >= 3), F.substring(F.col("full"), F.lit(1), F.length("full") - 1))
    return full.select("relation_id", F.explode(F.array("full", T.bare_name(F.col("full")), short)).alias("name")).where("length(name) >= 2").distinct()


def needs_place(st: DataFrame, boundaries: DataFrame, overrides: DataFrame, places: DataFrame) -> DataFrame:
    """st with needs_place: whether a name says too little without its city."""
    folded, elided = T.search_fold(F.col("name")), T.elision_fold(F.col("name"))
    runs = st.where("city is not null or settlement is not null").select("station_id", "boundary_ids", "lon", "lat", F.array_distinct(T.word_runs(folded, T.search_fold(F.col("latin")), F.nullif(elided, folded))).alias("runs"))
    words = runs.select("station_id", "boundary_ids", F.explode("runs").alias("name"))
    said = words.select("station_id", "name", F.explode("boundary_ids").alias("relation_id")).join(boundary_names(boundaries, overrides), ["relation_id", "name"]).select("station_id").distinct()
    named = places.select("lon", "lat", F.explode(F.array(T.search_fold(tag("name")), T.search_fold(tag("name:en")))).alias("pn")).where("pn is not null").distinct()
    asked = runs.join(said, "station_id", "left_anti").select("station_id", "lon", "lat", F.explode("runs").alias("pn"))
    after = within_join(asked, named, NAMED_AFTER_M, ["pn"]).select("station_id").distinct()
    alone = st.select("station_id", "mode", F.count(F.lit(1)).over(Window.partitionBy("mode", "country", folded)).alias("n")).where("n = 1")
    clear = said.unionByName(after.join(alone, "station_id", "left_semi")).unionByName(alone.where("mode in ('train', 'ferry', 'funicular')").select("station_id")).distinct().withColumn("_clear", F.lit(True))
    return st.join(clear, "station_id", "left").withColumn("needs_place", (F.col("city").isNotNull() | F.col("settlement").isNotNull()) & F.col("_clear").isNull()).drop("_clear")


def search_names(st: DataFrame, objects: DataFrame, rels: DataFrame) -> DataFrame:
    """station_id, mode, name, city_prefixed, place, code: every spelling to search on."""
    values = F.array_compact(F.concat(F.map_values("names"), F.array("latin")))
    own = st.select("station_id", "mode", F.explode(F.flatten(F.transform(values, lambda v: F.split(v, ";")))).alias("part")).select("station_id", "mode", F.trim("part").alias("name")).where("name <> ''").distinct()
    lifts = st.select("station_id", F.explode(F.array_compact(F.array("line_name", "ski_area"))).alias("prefix"))
    lines = own.join(lifts, "station_id").where(~F.contains(T.search_fold(F.col("name")), T.search_fold(F.col("prefix")))).select("station_id", "mode", F.concat_ws(" ", "prefix", "name").alias("name")).distinct()
    at = of_stations(st, objects).where("is_primary")
    others = at.where(has("name") & ~true(T.is_quay_code(tag("name")))).select("station_id", "mode", clean_name(tag("name"), tag("ref"), F.col("poles")).alias("name"))
    plain = own.unionByName(lines).unionByName(others).distinct()
    areas = st.select("station_id", "mode", F.explode("objects").alias("o")).where("o.type = 'R'").select("station_id", "mode", F.col("o.id").alias("relation_id")).join(rels.select("relation_id", "tags"), "relation_id")
    tags = at.select("station_id", "mode", "tags").unionByName(areas.select("station_id", "mode", "tags"))
    codes = tags.select("station_id", "mode", F.explode("tags").alias("k", "v")).where(T.is_code_key(F.col("k")))
    codes = codes.select("station_id", "mode", "k", F.explode(F.split("v", ";")).alias("part")).select("station_id", "mode", "k", F.trim("part").alias("name")).where(F.length("name") >= 2)
    codes = codes.where(~F.col("name").isin(*NO_CODES) & F.col("name").rlike("[0-9A-Za-z]") & ((F.col("k") != "esr:user") | F.col("name").rlike(r"^[0-9]{6}\z"))).select("station_id", "mode", "name").distinct()
    alone = F.col("settlement").isNull()
    cities = F.array_compact(F.array(tag("name", "city"), tag("name:en", "city"), tag("name", "settlement"), tag("name:en", "settlement"), F.when(alone, tag("name", "region")), F.when(alone, tag("name:en", "region"))))
    placed = plain.join(st.select("station_id", F.explode(cities).alias("city")), "station_id").where(~F.contains(T.search_fold(F.col("name")), T.search_fold(F.col("city"))))
    both = F.array(F.struct(F.concat_ws(" ", "city", "name").alias("name"), T.search_fold(F.col("city")).alias("place")), F.struct(F.concat_ws(" ", "name", "city").alias("name"), F.lit(None).cast("string").alias("place")))
    placed = placed.select("station_id", "mode", F.inline(both)).distinct()
    row = lambda df, prefixed, place, code: df.select("station_id", "mode", "name", F.lit(prefixed).alias("city_prefixed"), place, F.lit(code).alias("code"))
    none = F.lit(None).cast("string").alias("place")
    return row(plain, False, none, False).unionByName(row(codes, False, none, True)).unionByName(row(placed, True, F.col("place"), False))


def fold_column(names: DataFrame) -> DataFrame:
    return names.withColumn("folded", T.search_fold(F.col("name")))
