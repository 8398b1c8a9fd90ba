"""Sources of raw map objects and of what goes beside them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import path_centroid
from ..operators.rel import first_per

MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"
SETTLEMENTS = ("city", "town", "village", "hamlet")
OVERRIDES = "relation_id string, admin_level string, boundary_name string, name string, name_en string, note string"


def typed_tags(df: DataFrame) -> DataFrame:
    """tags, and members where there are some, from JSON text."""
    out = df.withColumn("tags", F.from_json("tags", "map<string,string>"))
    return out.withColumn("members", F.from_json("members", MEMBERS)) if "members" in df.columns else out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """code, parts (polygons as rings of points) of each feature; geometry is read as text, so polygons and multipolygons may mix."""
    features = spark.read.schema("features array<struct<properties:struct<countryCode:string>,geometry:string>>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    g = F.col("f.geometry")
    multi = F.from_json(g, "struct<coordinates:array<array<array<array<double>>>>>")["coordinates"]
    single = F.array(F.from_json(g, "struct<coordinates:array<array<array<double>>>>")["coordinates"])
    kind = F.get_json_object(g, "$.type")
    points = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    rings = lambda polys: F.transform(polys, lambda rs: F.transform(rs, points))
    return features.select(F.col("f.properties.countryCode").alias("code"), F.when(kind == "Polygon", rings(single)).otherwise(rings(multi)).alias("parts"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("comment", "#").option("header", True).schema(OVERRIDES).csv(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """mode, station_key, users: the counts of repeated keys added up."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy("mode", "station_key").agg(F.sum(F.col("users").cast("long")).alias("users"))


def tag_filter(objects: DataFrame, rules: str) -> DataFrame:
    """objects (type n, w or r; tags) that a rule keeps: a line of object types, a slash, a key and maybe =values."""
    keep = F.lit(False)
    for line in rules.splitlines():
        if m := re.fullmatch(r"\s*([nwr]+)/([^=\s]+)(?:=(\S+))?\s*", line):
            value = F.col("tags")[m[2]]
            found = value.isin(*m[3].split(",")) if m[3] else value.isNotNull()
            keep = keep | (F.lower("type").isin(*m[1]) & F.coalesce(found, F.lit(False)))
    return objects.where(keep)


def latest(objects: DataFrame) -> DataFrame:
    """Of each object in overlapping extracts, the newest version."""
    return first_per(objects, ["type", "id"], [F.col("version").desc()])


def _tag(k: str) -> Column:
    return F.col("tags")[k]


def is_stop() -> Column:
    kinds = (_tag("railway").isin("station", "halt", "tram_stop"), _tag("public_transport").isNotNull(), _tag("highway") == "bus_stop", _tag("amenity").isin("bus_station", "ferry_terminal"), _tag("aerialway") == "station")
    out = F.lit(False)
    for k in kinds:
        out = out | F.coalesce(k, F.lit(False))
    return out


def extract_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: id, tags, lon, lat. Stops and named settlements."""
    stops = nodes.where(is_stop()).select(F.lit("N").alias("osm_type"), F.col("id").alias("osm_id"), "tags", "lon", "lat")
    places = nodes.where(_tag("place").isin(*SETTLEMENTS) & _tag("name").isNotNull()).select(F.col("id").alias("node_id"), _tag("place").alias("place"), "tags", "lon", "lat")
    return stops, places


def extract_ways(ways: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ways: id, tags, path. Stops at a way's middle, named lifts and funiculars, named closed ski areas."""
    middle = path_centroid(F.col("path"))
    stops = ways.where(is_stop()).select(F.lit("W").alias("osm_type"), F.col("id").alias("osm_id"), "tags", middle["lon"].alias("lon"), middle["lat"].alias("lat"))
    lift = F.coalesce(~_tag("aerialway").isin("station", "pylon", "goods"), F.lit(False))
    lines = ways.where(_tag("name").isNotNull() & (lift | F.coalesce(_tag("railway") == "funicular", F.lit(False)))).select(F.col("id").alias("way_id"), F.when(lift, "aerialway").otherwise("funicular").alias("kind"), _tag("name").alias("name"), "path")
    closed = (F.size("path") > 3) & (F.element_at("path", 1) == F.element_at("path", -1))
    ski = ways.where((_tag("landuse") == "winter_sports") & _tag("name").isNotNull()).where(closed).select(F.lit("W").alias("osm_type"), F.col("id").alias("osm_id"), _tag("name").alias("name"), F.array(F.array("path")).alias("parts"))
    return stops, lines, ski


def extract_relations(rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rels: id, tags, members, parts. Ski areas, else boundaries at level 2 or 4 to 8, else stop areas and routes with their useful members."""
    ski = F.coalesce((_tag("landuse") == "winter_sports") & _tag("name").isNotNull() & (_tag("type") == "multipolygon"), F.lit(False))
    admin = F.coalesce(_tag("boundary") == "administrative", F.lit(False))
    level = F.expr("try_cast(tags['admin_level'] as int)")
    area = F.coalesce(_tag("public_transport") == "stop_area", F.lit(False))
    members = F.filter("members", lambda m: area | (F.lower(m["type"]) == "n"))
    members = F.transform(members, lambda m: F.struct(F.upper(m["type"]).alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
    one = rels.where(ski).select(F.lit("R").alias("osm_type"), F.col("id").alias("osm_id"), _tag("name").alias("name"), "parts")
    two = rels.where(~ski & admin & ((level == 2) | level.between(4, 8))).select(F.col("id").alias("relation_id"), level.alias("admin_level"), "tags", "parts")
    three = rels.where(~ski & ~admin & (area | _tag("route").isNotNull())).select(F.col("id").alias("relation_id"), "tags", members.alias("members")).where(F.size("members") > 0)
    return one, two, three
