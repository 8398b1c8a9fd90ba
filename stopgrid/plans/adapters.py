"""Raw map objects made from the star-schema tables, so that every step has rows to work on and SQL can say the same.

Each adapter is one SQL text with plain tag columns that both engines read; Spark's side gathers the columns into the tags map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import load, run_sql

DBL = "CAST({} AS DOUBLE)"
LON = "CAST(2.0 AS DOUBLE) + CAST(({k} * {a}) % {b} AS DOUBLE) / CAST({b} AS DOUBLE) * CAST(0.25 AS DOUBLE)"
LAT = "CAST(48.7 AS DOUBLE) + CAST(({k} * {a}) % {b} AS DOUBLE) / CAST({b} AS DOUBLE) * CAST(0.2 AS DOUBLE)"

#: Stop positions of trains stand beside the platform six keys on.
BESIDE = "(c_custkey + CASE WHEN c_custkey % 24 = 5 THEN 6 ELSE 0 END)"
#: Customers as stops: kinds by the key modulo 12.
STOPS = f"""
SELECT 'N' AS osm_type, c_custkey AS osm_id,
  CASE WHEN c_custkey % 12 IN (0, 10) THEN 'station' WHEN c_custkey % 12 = 1 THEN 'tram_stop' WHEN c_custkey % 12 = 11 THEN 'platform' END AS railway,
  CASE WHEN c_custkey % 12 IN (2, 3) THEN 'bus_stop' END AS highway,
  CASE WHEN c_custkey % 12 = 4 THEN 'bus_station' WHEN c_custkey % 60 = 9 THEN 'ferry_terminal' END AS amenity,
  CASE WHEN c_custkey % 12 IN (5, 6) THEN 'stop_position' WHEN c_custkey % 12 IN (7, 11) THEN 'platform' END AS public_transport,
  CASE WHEN c_custkey % 12 = 8 THEN 'station' END AS aerialway,
  CASE WHEN c_custkey % 12 = 10 THEN 'subway' END AS station,
  CASE WHEN c_custkey % 24 IN (5, 10, 11) THEN 'yes' END AS train,
  CASE WHEN c_custkey % 12 = 6 THEN 'yes' END AS tram,
  CASE WHEN c_custkey % 12 = 7 THEN 'yes' END AS bus,
  CASE WHEN c_custkey % 12 NOT IN (5, 6, 11) THEN c_mktsegment || ' ' || (c_nationkey % 5) END AS name,
  CASE WHEN c_custkey % 12 = 11 THEN CAST(c_custkey % 9 + 1 AS VARCHAR(9)) END AS ref,
  CASE WHEN c_custkey % 36 = 0 THEN 'Q' || (c_custkey % 72) WHEN c_custkey % 48 = 0 THEN 'x' END AS wikidata,
  CASE WHEN c_custkey % 24 = 0 THEN '87' || c_custkey END AS uic_ref,
  {LON.format(k=BESIDE, a=7919, b=2003)} + CAST(c_custkey % 24 IN (5) AS INTEGER) * CAST(0.0002 AS DOUBLE) AS lon, {LAT.format(k=BESIDE, a=104729, b=1999)} AS lat
FROM {{customer}}"""
STOP_TAGS = ("railway", "highway", "amenity", "public_transport", "aerialway", "station", "train", "tram", "bus", "name", "ref", "wikidata", "uic_ref")

#: Orders as relations, every 65th a stop area (more would make one area of all) and the others routes; their items are the members, by (line number, part, supplier, quantity, price).
RELS = """
SELECT o_orderkey AS relation_id,
  CASE WHEN o_orderkey % 65 = 0 THEN 'stop_area' END AS public_transport,
  CASE o_orderkey % 5 WHEN 1 THEN 'train' WHEN 2 THEN 'subway' WHEN 3 THEN 'tram' WHEN 4 THEN 'light_rail' ELSE CASE WHEN o_orderkey % 65 <> 0 THEN 'ferry' END END AS route,
  CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 = 0 THEN 'TGV ' || (o_orderkey % 900 + 100) WHEN o_orderkey % 7 <> 0 THEN 'L' || (o_orderkey % 30) END AS ref,
  CASE WHEN o_orderkey % 11 = 0 THEN 'night' END AS service,
  CASE WHEN o_orderkey % 2 = 0 THEN '#' || (o_orderkey % 100) END AS colour,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS name
FROM {orders}"""
REL_TAGS = ("public_transport", "route", "ref", "service", "colour", "name")
MEMBERS = """
SELECT l_orderkey AS relation_id, 'N' AS osm_type, l_partkey AS osm_id,
  CASE WHEN l_orderkey % 2 = 0 AND l_returnflag = 'A' THEN 'stop_exit' WHEN l_returnflag = 'R' THEN 'platform' ELSE '' END AS role,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS seq
FROM {lineitem}"""

#: Suppliers as settlements.
PLACES = f"""
SELECT s_suppkey AS node_id, CASE s_suppkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS place,
  CASE s_suppkey % 6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE s_name END AS name,
  {LON.format(k='s_suppkey', a=6007, b=1009)} AS lon, {LAT.format(k='s_suppkey', a=3001, b=997)} AS lat
FROM {{supplier}}"""

#: Nations as 25 municipal rectangles, regions as five columns of them, and all as one country.
RECTANGLES = """
SELECT CAST(n_nationkey AS BIGINT) AS relation_id, CAST(8 AS INTEGER) AS admin_level, n_name AS name, CAST(NULL AS VARCHAR(9)) AS iso, CAST(NULL AS VARCHAR(9)) AS place,
  CAST(2.0 AS DOUBLE) + n_nationkey % 5 * CAST(0.05 AS DOUBLE) AS x0, CAST(48.7 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.04 AS DOUBLE) AS y0, CAST(0.05 AS DOUBLE) AS w, CAST(0.04 AS DOUBLE) AS h FROM {nation}
UNION ALL
SELECT CAST(100 + r_regionkey AS BIGINT), CAST(4 AS INTEGER), r_name, 'FR-' || r_regionkey, CASE WHEN r_regionkey = 2 THEN 'city' END,
  CAST(2.0 AS DOUBLE) + r_regionkey * CAST(0.05 AS DOUBLE), CAST(48.7 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE) FROM {region}
UNION ALL
SELECT CAST(200 AS BIGINT), CAST(2 AS INTEGER), 'France', 'FR', CAST(NULL AS VARCHAR(9)), CAST(1.9 AS DOUBLE), CAST(48.6 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.4 AS DOUBLE)"""

OVERRIDES = (("3", None, None, "Third", None, None), (None, "8", "NATION_4", "Fourth", "Fourth in English", None), (None, "4", "NATION_5", "wrong level", None, None))
LIFTS = ((1, "aerialway", "Gondel", 2.01, 48.71, 2.03, 48.73), (2, "aerialway", "Gondel", 2.03, 48.73, 2.05, 48.75), (3, "aerialway", "HOUSEHOLD 1", 2.1, 48.8, 2.12, 48.82), (4, "funicular", "Zahnradbahn", 2.15, 48.72, 2.16, 48.73))
SKI = (("W", 1, "Small area", 2.0, 48.7, 0.06, 0.06), ("R", 2, "Large area", 1.99, 48.69, 0.2, 0.2))


def _tags(names: tuple[str, ...]) -> Column:
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _box(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    return F.array(at(x0, y0), at(x0 + w, y0), at(x0 + w, y0 + h), at(x0, y0 + h), at(x0, y0))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt first, as the tags of a small file would be one task's
    return run_sql(spark, sf_dir, STOPS, customer=load(spark, sf_dir, "customer").repartition("c_custkey")).select("osm_type", "osm_id", _tags(STOP_TAGS).alias("tags"), "lon", "lat")


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of MEMBERS as lists in its order, by one shuffle and one sort: the first row of each relation has them all."""
    items = load(spark, sf_dir, "lineitem").withColumn("relation_id", F.col("l_orderkey"))
    role = F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_returnflag") == "A"), "stop_exit").when(F.col("l_returnflag") == "R", "platform").otherwise("")
    by = Window.partitionBy("relation_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    member = F.struct(F.lit("N").alias("type"), F.col("l_partkey").alias("ref"), F.col("role"))
    listed = F.collect_list(member).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    m = items.withColumn("role", role).select("relation_id", F.row_number().over(by).alias("seq"), listed.alias("members")).where("seq = 1").drop("seq")
    return run_sql(spark, sf_dir, RELS).join(m, "relation_id").select("relation_id", _tags(REL_TAGS).alias("tags"), "members")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PLACES).select("node_id", "place", _tags(("name", "place")).alias("tags"), "lon", "lat")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, RECTANGLES)
    tags = F.map_filter(F.create_map(F.lit("name"), "name", F.lit("place"), "place", F.lit("ISO3166-2"), F.when(F.col("admin_level") == 4, F.col("iso")), F.lit("ISO3166-1:alpha2"), F.when(F.col("admin_level") == 2, F.col("iso"))), lambda k, v: v.isNotNull())
    return rows.select("relation_id", "admin_level", tags.alias("tags"), F.array(F.array(_box(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")))).alias("parts"))


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = spark.createDataFrame(LIFTS, "way_id long, kind string, name string, ax double, ay double, bx double, by_ double")
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ski = spark.createDataFrame(SKI, "osm_type string, osm_id long, name string, x double, y double, w double, h double")
    country = spark.createDataFrame([("FR", 1.9, 48.6, 0.4, 0.3)], "code string, x double, y double, w double, h double")
    box = F.array(F.array(_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))))
    return {
        "stops": stops(spark, sf_dir),
        "rels": rels(spark, sf_dir),
        "places": places(spark, sf_dir),
        "boundaries": boundaries(spark, sf_dir),
        "line_ways": lines.select("way_id", "kind", "name", F.array(at("ax", "ay"), at("bx", "by_")).alias("path")),
        "ski_areas": ski.select("osm_type", "osm_id", "name", box.alias("parts")),
        "countries": country.select("code", box.alias("parts")),
        "overrides": spark.createDataFrame(OVERRIDES, "relation_id string, admin_level string, boundary_name string, name string, name_en string, note string"),
    }
