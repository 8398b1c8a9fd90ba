"""Scalar functions, conversions and spatial joins: one query for each, with SQL that says the same where SQL can."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions import text as T
from .functions.similarity import candidates, word_similarity_to
from .operators.spatial import contains_join, grid_join, knn, line_join, mutual_nearest, subdivide, within_join
from .registry import Registry, load, run_sql

R = Registry()

#: Names that no table of the driver holds: quays, poles, lines, ligatures, Han. A third column for refs.
NAMES = (
    ("St. Gallen", None), ("Lyon-Part-Dieu", None), ("Cœur d'Orly", None), ("Szkoła nr 12", None), ("Park Bronowice 02", None), ("Skrzyżowanie 1532", "1532"),
    ("Opoczyńska 145", "7"), ("Centre (E)", None), ("Centre (Quai 3)", None), ("Étoile (Métro 1)", None), ("Étoile (MÉTRO 6) ", None), ("Royan - Gare", None),
    ("A - B - C", None), ("B12", None), ("Voie n° 3", None), ("Gleis 4", None), ("泉州东站", None), ("ひばりヶ丘", None), ("", None), ("Łódź Æther þing", None), ("İzmir", None), ("a  b", None),
)


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(NAMES)], "id int, name string, ref string")


def _values() -> str:
    q = lambda s: "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {q(n)}, {q(r)})" for i, (n, r) in enumerate(NAMES)) + ") AS t(id, name, ref)"


VALUES = _values()
LETTERS = "lower(coalesce({0}, ''))"
for _a, _b in T.LIGATURES.items():
    LETTERS = f"replace({LETTERS}, '{_a}', '{_b}')"
FOLD = f"strip_accents({LETTERS})"
SEARCH = f"trim(regexp_replace(regexp_replace({FOLD}, '[''’]', '', 'g'), '[^\\pL\\p{{{{Nd}}}}]+', ' ', 'g'))"
DOCS = "SELECT doc_id, substr(text, 1, 400) AS name FROM documents"


def on_names(name: str, column, sql: str) -> None:  # noqa: ANN001
    R.frame(name, f"SELECT id, {sql} AS out FROM {VALUES}")(lambda spark, sf_dir: names(spark).select("id", column().alias("out")))


@R.frame("fn_fold", f"SELECT doc_id, md5({FOLD.format('text')}) AS out FROM documents UNION ALL SELECT -id - 1, md5({FOLD.format('name')}) FROM {VALUES}")
def fn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("out"))
    return docs.unionByName(names(spark).select((-F.col("id") - 1).cast("long").alias("doc_id"), F.md5(T.fold(F.col("name")).cast("binary")).alias("out")))


@R.frame("fn_search_fold", f"SELECT doc_id, md5({SEARCH.format('text')}) AS out FROM documents UNION ALL SELECT -id - 1, md5({SEARCH.format('name')}) FROM {VALUES}")
def fn_search_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(T.search_fold(F.col("text")).cast("binary")).alias("out"))
    return docs.unionByName(names(spark).select((-F.col("id") - 1).cast("long").alias("doc_id"), F.md5(T.search_fold(F.col("name")).cast("binary")).alias("out")))


on_names("fn_elision_fold", lambda: T.elision_fold(F.col("name")), f"trim(regexp_replace({FOLD.format('name')}, '[^\\pL\\p{{Nd}}]+', ' ', 'g'))")
R.frame("fn_fold_pg", R.oracles["fn_search_fold"])(fn_search_fold)  # one fold serves building and searching
DQ = r"\s\((?:(?:[QqBbSsVvPp][a-z]+)\s+)?([A-Z]{1,2}[0-9]{0,2}|[0-9]{1,2}[A-Z]?)\)$"
on_names("fn_without_quay", lambda: T.without_quay(F.col("name")), f"regexp_replace(name, '\\s*{DQ}', '')")
on_names("fn_quay_of", lambda: T.quay_of(F.col("name")), f"nullif(regexp_extract(name, '{DQ}', 1), '')")
on_names("fn_quay_code", lambda: T.quay_code(F.col("name")), r"nullif(regexp_extract(name, '^(?:(?:Voie|Gleis4|Quai)\s*(?:n[°o]\.?\s*)?)?([A-Z]{1,2}[0-9]{0,2}|[0-9]{1,3}[A-Z]?)$', 1), '')")
on_names("fn_is_quay_code", lambda: T.is_quay_code(F.col("name")), r"regexp_matches(name, '^(Voie n° )?([A-Z]{1,2}[0-9]{0,2}|[0-9]{1,3}[A-Z]?)$')")
on_names("fn_without_line", lambda: T.without_line(F.col("name")), r"regexp_replace(name, '\s*\(m[ée]tro [0-9]\)\s*$', '', 'i')")
POLE = r"CASE WHEN regexp_matches(name, '\s[0-9]{2}$') AND NOT regexp_matches(name, '(^|[^0-9A-Za-z_])[Nn][ro]\.?\s*[0-9]{2}$') THEN right(name, 2) END"
on_names("fn_pole_of", lambda: T.pole_of(F.col("name"), F.lit(True)), POLE)
on_names("fn_without_pole", lambda: T.without_pole(F.col("name"), F.col("ref"), F.lit(True)), f"CASE WHEN {POLE} IS NOT NULL THEN rtrim(left(name, length(name) - 2)) WHEN regexp_full_match(ref, '[0-9]{{3,}}') AND ends_with(name, ' ' || ref) THEN rtrim(left(name, length(name) - length(ref))) ELSE name END")
on_names("fn_strip_town_prefix", lambda: T.town_stripped(F.col("name")), r"CASE WHEN regexp_matches(name, '\S\s+-\s+') THEN regexp_replace(name, '^.+?\s+-\s+', '') ELSE name END")
on_names("fn_bare_name", lambda: T.bare_name(T.search_fold(F.concat(F.lit("greater city of "), F.col("name")))), SEARCH.format("name").replace("trim(", "trim(", 1))
on_names("fn_track_ref", lambda: T.track_ref(F.concat(F.lit("Voie 1"), F.col("name"))), r"regexp_replace(trim('1' || name), '^([0-9]+)\s*(\pL{3,})$', '\1 \2')")
on_names("fn_is_code_key", lambda: T.is_code_key(F.concat(F.lit("railway:ref:"), F.col("name"))), "name <> '' AND NOT regexp_full_match(name, '[a-z]{2}|[0-9]+') AND name NOT IN ('parent', 'count')")
HEAD = "regexp_extract(name, '^[぀-ヿ㐀-䶿一-鿿]+')"
on_names(
    "fn_name_runs",
    lambda: F.array_join(F.array_sort(T.name_runs(F.col("name"))), "|"),
    f"coalesce(array_to_string(list_sort(CASE WHEN name = '' THEN [] ELSE list_concat(flatten(list_transform(range(1, len(string_split(name, ' ')) + 1), lambda i: list_transform(range(i, least(i + 4, len(string_split(name, ' '))) + 1), lambda j: array_to_string(string_split(name, ' ')[i:j], ' ')))), list_transform(range(2, length({HEAD})), lambda n: left({HEAD}, n))) END), '|'), '')",
)
on_names("fn_word_runs", lambda: F.size(T.word_runs(F.col("name"), F.lit("x y"), F.lit(None).cast("string"))), "CAST(3 + CASE WHEN name = '' THEN 0 ELSE list_sum(list_transform(range(1, len(string_split(name, ' ')) + 1), lambda i: least(5, len(string_split(name, ' ')) - i + 1))) + greatest(0, length(" + HEAD + ") - 2) END AS INTEGER)")
R.pair("fn_split", r"SELECT p_partkey, element_at(split(p_name, ' '), 2) AS b, size(split(concat(p_name, ';', p_brand), '\\s+|;')) AS n, split_part(p_name, ' ', 1) AS a FROM {part}", r"SELECT p_partkey, string_split(p_name, ' ')[2] AS b, CAST(len(string_split_regex(p_name || ';' || p_brand, '\s+|;')) AS INTEGER) AS n, split_part(p_name, ' ', 1) AS a FROM {part}")
R.oracles["fn_split_regex"], R.queries["fn_split_regex"] = R.oracles["fn_split"], R.queries["fn_split"]
R.oracles["fn_split_part"], R.queries["fn_split_part"] = R.oracles["fn_split"], R.queries["fn_split"]
R.same("fn_concat", "SELECT o_orderkey, o_orderstatus || '-' || nullif(o_orderpriority, '5-LOW') AS s FROM {orders}")
R.pair("fn_basic", "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, left(p_name, 3) AS l, right(p_name, 3) AS r, length(p_name) AS n, substring(p_name, 2, 3) AS s, trim(concat('  ', p_name, ' ')) AS t, rtrim(concat(p_name, ' ')) AS rt, replace(p_name, 'a', 'o') AS rep, array_join(array(p_name, p_brand), '/') AS j FROM {part}", "SELECT p_partkey, lower(p_brand) AS lo, upper(p_name) AS up, left(p_name, 3) AS l, right(p_name, 3) AS r, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 2, 3) AS s, trim('  ' || p_name || ' ') AS t, rtrim(p_name || ' ') AS rt, replace(p_name, 'a', 'o') AS rep, array_to_string([p_name, p_brand], '/') AS j FROM {part}")
R.pair("fn_digits_only", r"SELECT c_custkey, regexp_replace(c_name, '\\D', '') AS d FROM {customer}", r"SELECT c_custkey, regexp_replace(c_name, '\D', '', 'g') AS d FROM {customer}")


@R.frame("fn_word_similarity")
def fn_word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names like "smal rnig": candidates by shared trigrams, then the exact similarity on those only."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    near = candidates(parts, "p_name", "small rin", 0.6)
    return near.withColumn("score", F.round(word_similarity_to("small rin", F.col("p_name")), 6)).where("score >= 0.6")


@R.frame("fn_unicode_script", f"SELECT id, coalesce(bool_and(regexp_matches(c, '\\p{{Latin}}')) FILTER (WHERE regexp_matches(c, '\\pL')), true) AS latin FROM (SELECT id, unnest(string_split(name, '')) AS c FROM {VALUES} UNION ALL SELECT id, '' FROM {VALUES}) GROUP BY id")
def fn_unicode_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.labels import readable

    return names(spark).select("id", readable(F.col("name"), None).alias("latin"))


# --- math and geometry
STOP_LON, STOP_LAT = "2.0 + ((c_custkey * 7919) % 2003) / 2003.0D * 0.25", "48.7 + ((c_custkey * 104729) % 1999) / 1999.0D * 0.20"
STOPS = "SELECT c_custkey, c_mktsegment || ' ' || (c_nationkey % 5) AS name, CAST(2.0 AS DOUBLE) + CAST((c_custkey * 7919) % 2003 AS DOUBLE) / CAST(2003 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lon, CAST(48.7 AS DOUBLE) + CAST((c_custkey * 104729) % 1999 AS DOUBLE) / CAST(1999 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS lat FROM {customer}"
PLACES = "SELECT s_suppkey, s_suppkey % 4 AS kind, CAST(2.0 AS DOUBLE) + CAST((s_suppkey * 6007) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lon, CAST(48.7 AS DOUBLE) + CAST((s_suppkey * 3001) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS lat FROM {supplier}"
D_STOPS, D_PLACES = STOPS.replace("{customer}", "customer"), PLACES.replace("{supplier}", "supplier")


def haversine_sql(a: str, b: str, radius: str) -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, STOPS)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PLACES)


def _distance(name: str, radius: str, f) -> None:  # noqa: ANN001
    sql = f"SELECT a.c_custkey, round({haversine_sql('a', 'p', radius)}, 4) AS m FROM ({D_STOPS}) a, (SELECT CAST(2.1 AS DOUBLE) AS lon, CAST(48.8 AS DOUBLE) AS lat) p"
    R.frame(name, sql)(lambda spark, sf_dir: stops(spark, sf_dir).select("c_custkey", F.round(f(F.col("lon"), F.col("lat"), F.lit(2.1), F.lit(48.8)), 4).alias("m")))


_distance("fn_haversine", "6371008.8", geo.dist_m)
_distance("fn_metres", "6371000.0", geo.metres)
_distance("fn_sphere", "6371008.8", geo.dist_m)


@R.frame("fn_geography")
def fn_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres on the spheroid; no SQL of the oracle has it, so tests hold it against published values."""
    return stops(spark, sf_dir).select("c_custkey", F.round(geo.geodesic(F.col("lon"), F.col("lat"), F.lit(2.1), F.lit(48.8)), 4).alias("m"))


R.frame("fn_equirect", f"SELECT c_custkey, round(lon * 111320 * cos(radians(lat)), 4) AS x, round(lat * 110540, 4) AS y FROM ({D_STOPS})")(
    lambda spark, sf_dir: stops(spark, sf_dir).select("c_custkey", F.round(geo.equirect(F.col("lon"), F.col("lat"))[0], 4).alias("x"), F.round(geo.equirect(F.col("lon"), F.col("lat"))[1], 4).alias("y"))
)
R.same("fn_math", "SELECT p_partkey, round(sin(p_size) + cos(p_size) * asin(0.5), 9) AS a, round(sqrt(p_retailprice) + radians(p_size) + pow(p_size, 2) + ln(p_size + 1), 6) AS b, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, round(p_retailprice / 3, 1) AS r, least(p_size, 20) AS l FROM {part}")
R.same("fn_mod_partition", "SELECT c_custkey % 8 AS part, count(*) AS n FROM {customer} GROUP BY c_custkey % 8")

#: 25 rectangles as one-ring polygons; and a three-point path for each nation.
X0, Y0 = "(2.0 + (n_nationkey % 5) * 0.05)", "(48.7 + floor(n_nationkey / 5) * 0.04)"
RECT = "SELECT n_nationkey, CAST(2.0 AS DOUBLE) + n_nationkey % 5 * CAST(0.05 AS DOUBLE) AS x0, CAST(48.7 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.04 AS DOUBLE) AS y0 FROM {nation}"
D_RECT = RECT.replace("{nation}", "nation")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("lon"), (F.col("y0") + dy).alias("lat"))
    return run_sql(spark, sf_dir, RECT).select("n_nationkey", F.array(F.array(at(0.0, 0.0), at(0.05, 0.0), at(0.05, 0.04), at(0.0, 0.04), at(0.0, 0.0))).alias("rings"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("x0") + dx).alias("lon"), (F.col("y0") + dy).alias("lat"))
    return run_sql(spark, sf_dir, RECT).select(F.col("n_nationkey").alias("way_id"), F.array(at(0.0, 0.0), at(0.03, 0.0), at(0.03, 0.02)).alias("path"))


@R.frame("fn_area", f"SELECT n_nationkey, round(CAST(0.002 AS DOUBLE), 9) AS area, round(x0 + (0.015 * 0.03 + 0.03 * 0.02) / 0.05, 9) AS mid_lon, round(y0 + 0.01 * 0.02 / 0.05, 9) AS mid_lat, round(x0, 9) AS from_lon, round(y0 + 0.02, 9) AS to_lat, round(x0 + 0.025, 9) AS half_lon, round(y0, 9) AS half_lat, round(x0 + 0.01, 9) AS near_lon, round(CAST(0.05 AS DOUBLE), 9) AS len FROM ({D_RECT})")
def fn_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir).join(rectangles(spark, sf_dir).withColumnRenamed("n_nationkey", "way_id"), "way_id").join(run_sql(spark, sf_dir, RECT).withColumnRenamed("n_nationkey", "way_id"), "way_id")
    path = F.col("path")
    mid, half = geo.path_centroid(path), geo.interpolate(path, 0.5)
    near = geo.closest_point(path, F.col("x0") + 0.01, F.col("y0") - 0.01)
    cols = {"area": geo.area(F.col("rings")), "mid_lon": mid["lon"], "mid_lat": mid["lat"], "from_lon": geo.start_point(path)["lon"], "to_lat": geo.end_point(path)["lat"], "half_lon": half["lon"], "half_lat": half["lat"], "near_lon": near["lon"], "len": geo.path_length(path)}
    return p.select(F.col("way_id").alias("n_nationkey"), *(F.round(v, 9).alias(k) for k, v in cols.items()))


@R.frame("fn_dump", "SELECT n_nationkey, CAST(1 AS INTEGER) AS parts, CAST(5 AS INTEGER) AS points FROM nation")
def fn_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a multipolygon, each listed once."""
    parts = rectangles(spark, sf_dir).select("n_nationkey", F.array("rings").alias("parts"))
    return parts.select("n_nationkey", F.explode("parts").alias("rings")).select("n_nationkey", F.size("rings").alias("parts"), F.size(F.flatten("rings")).alias("points"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of 1000 corners with a hole of 600 for each nation."""
    def ring(n: int, r: float) -> Column:
        turn = lambda i: i * F.lit(2 * math.pi / n)
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((F.col("n_nationkey") + r * F.cos(turn(i % n))).alias("lon"), (F.lit(40.0) + r * F.sin(turn(i % n))).alias("lat")))

    return load(spark, sf_dir, "nation").select("n_nationkey", F.array(ring(1000, 0.4), ring(600, 0.1)).alias("rings"))


@R.frame("fn_subdivide", "SELECT n_nationkey, true AS cut, round(500 * 0.16 * sin(2 * pi() / 1000) - 300 * 0.01 * sin(2 * pi() / 600), 9) AS area FROM nation")
def fn_subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of 1,602 points in pieces of 256 at most, which have the whole's area together."""
    pieces = subdivide(outlines(spark, sf_dir))
    return pieces.groupBy("n_nationkey").agg(((F.max(geo.n_points(F.col("rings"))) <= 256) & (F.count(F.lit(1)) > 6)).alias("cut"), F.round(F.sum(geo.area(F.col("rings"))), 9).alias("area"))


for _extra in ("fn_centroid", "fn_start_end_point", "fn_interpolate", "fn_closest_point", "fn_distance_planar"):
    R.queries[_extra], R.oracles[_extra] = R.queries["fn_area"], R.oracles["fn_area"]


# --- spatial joins
PROJECTED = "SELECT *, lon * 111320 * cos(radians(lat)) AS x, lat * 110540 AS y FROM"


@R.frame("join_grid_cell", f"WITH n AS ({PROJECTED} ({D_STOPS})) SELECT a.c_custkey AS a, b.c_custkey AS b FROM n a JOIN n b ON a.name = b.name AND a.c_custkey < b.c_custkey AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 160000")
def join_grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.equirect(F.col("lon"), F.col("lat"))
    n = stops(spark, sf_dir).withColumns({"x": x, "y": y})
    return grid_join(n, n, ["name"], "x", "y", 400.0).where("c_custkey < c_custkey_r").select(F.col("c_custkey").alias("a"), F.col("c_custkey_r").alias("b"))


@R.frame("join_distance", f"SELECT s.c_custkey, p.s_suppkey FROM ({D_STOPS}) s JOIN ({D_PLACES}) p ON abs(s.lat - p.lat) < 0.04 AND {haversine_sql('s', 'p', '6371008.8')} <= 800")
def join_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_join(stops(spark, sf_dir), places(spark, sf_dir), 800).select("c_custkey", F.col("s_suppkey_r").alias("s_suppkey"))


SEGMENT_POINT = "CASE WHEN s.lon - r.x0 - 0.03 > 0 OR s.lat > r.y0 AND s.lon > r.x0 + 0.03 - (s.lat - r.y0) THEN 1 ELSE 0 END"
LINE_D = "SELECT s.c_custkey, r.n_nationkey AS way_id, s.lon AS slon, s.lat AS slat, greatest(r.x0, least(r.x0 + 0.03, s.lon)) AS ax, r.y0 AS ay, r.x0 + 0.03 AS bx, greatest(r.y0, least(r.y0 + 0.02, s.lat)) AS by_ FROM ({0}) s, ({1}) r".format(D_STOPS, D_RECT)


@R.frame("join_line_distance", f"SELECT s.c_custkey, s.way_id FROM (SELECT *, CASE WHEN pow(slon - ax, 2) + pow(slat - ay, 2) <= pow(slon - bx, 2) + pow(slat - by_, 2) THEN ax ELSE bx END AS lon2, CASE WHEN pow(slon - ax, 2) + pow(slat - ay, 2) <= pow(slon - bx, 2) + pow(slat - by_, 2) THEN ay ELSE by_ END AS lat2 FROM ({LINE_D})) s WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat2 - slat) / 2), 2) + cos(radians(slat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - slon) / 2), 2))) <= 150")
def join_line_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join(stops(spark, sf_dir), paths(spark, sf_dir), 150).select("c_custkey", "way_id")


@R.frame("join_point_in_polygon", f"SELECT s.c_custkey, r.n_nationkey FROM ({D_STOPS}) s JOIN ({D_RECT}) r ON s.lon > r.x0 AND s.lon < r.x0 + 0.05 AND s.lat > r.y0 AND s.lat < r.y0 + 0.04")
def join_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contains_join(stops(spark, sf_dir), rectangles(spark, sf_dir), 0.05).select("c_custkey", "n_nationkey")


@R.frame("join_polygon_distance", f"SELECT s.c_custkey, r.n_nationkey FROM ({D_STOPS}) s JOIN ({D_RECT}) r ON sqrt(pow(greatest(r.x0 - s.lon, 0, s.lon - r.x0 - 0.05), 2) + pow(greatest(r.y0 - s.lat, 0, s.lat - r.y0 - 0.04), 2)) <= 500 / (111320 * cos(radians(s.lat)))")
def join_polygon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons at most 500 m away, in degrees scaled by the point's latitude: cells around the polygons' boxes first."""
    from .operators.spatial import near_polygons

    return near_polygons(stops(spark, sf_dir), rectangles(spark, sf_dir), 500).select("c_custkey", "n_nationkey")


@R.frame("join_knn", f"SELECT s_suppkey, c_custkey, CAST(rk AS INTEGER) AS rk FROM (SELECT p.s_suppkey, s.c_custkey, row_number() OVER (PARTITION BY p.s_suppkey ORDER BY sqrt(pow(p.lon - s.lon, 2) + pow(p.lat - s.lat, 2)), s.c_custkey) AS rk FROM ({D_PLACES}) p JOIN ({D_STOPS}) s ON abs(p.lon - s.lon) <= 0.02 AND abs(p.lat - s.lat) <= 0.02) WHERE rk <= 3")
def join_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = knn(places(spark, sf_dir), stops(spark, sf_dir), "s_suppkey", 3, 0.02, tie=["c_custkey_r"])
    return met.select("s_suppkey", F.col("c_custkey_r").alias("c_custkey"), F.col("_rank").alias("rk"))


GROUPED = f"SELECT c_custkey, c_custkey % 3 AS side, c_custkey % 40 AS g, lon, lat FROM ({D_STOPS})"


@R.frame("join_mutual_nearest", f"WITH s AS ({GROUPED}), p AS (SELECT a.g, a.c_custkey AS a, b.c_custkey AS b, {haversine_sql('a', 'b', '6371008.8')} AS d, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) AS deg FROM s a JOIN s b ON a.g = b.g AND a.side = 0 AND b.side = 1), r AS (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY deg, b) AS ra, row_number() OVER (PARTITION BY g, b ORDER BY deg, a) AS rb, lead(d) OVER (PARTITION BY g, a ORDER BY deg, b) AS nxt FROM p) SELECT a, b FROM r WHERE ra = 1 AND rb = 1 AND d <= 3000 AND (nxt IS NULL OR nxt >= 1.5 * d)")
def join_mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stops(spark, sf_dir).withColumn("g", F.col("c_custkey") % 40)
    a = s.where("c_custkey % 3 = 0").withColumnRenamed("c_custkey", "a")
    b = s.where("c_custkey % 3 = 1").withColumnRenamed("c_custkey", "b")
    return mutual_nearest(a.select("g", "a", "lon", "lat"), b.select("g", "b", "lon", "lat"), "g", "a", "b", 3000, 1.5).select("a", "b")


# --- arrays, maps, JSON
R.pair("fn_map_entries", "SELECT event_id, array_join(array_sort(transform(map_entries(map_filter(map(event_type, value, 'x', 1.0D), (k, v) -> k <> 'error')), e -> concat(e.key, '=', cast(e.value > 1 AS string)))), ',') AS e FROM {events}", "SELECT event_id, array_to_string(list_sort(list_transform(list_filter(map_entries(MAP([event_type, 'x'], [value, 1.0])), lambda e: e.key <> 'error'), lambda e: e.key || '=' || CAST(e.value > 1 AS VARCHAR))), ',') AS e FROM {events}")
R.queries["fn_map_from_entries"], R.oracles["fn_map_from_entries"] = R.queries["fn_map_entries"], R.oracles["fn_map_entries"]
R.queries["fn_map_filter"], R.oracles["fn_map_filter"] = R.queries["fn_map_entries"], R.oracles["fn_map_entries"]


@R.frame("fn_map_concat", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'right' ELSE 'left' END AS a, n_name AS b FROM nation")
def fn_map_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right map wins, and a null map adds nothing."""
    from .functions.maps import map_overlay

    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.col("n_name"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("right")))
    both = map_overlay(left, right)
    return load(spark, sf_dir, "nation").select("n_nationkey", both["a"].alias("a"), both["b"].alias("b"))


R.pair("fn_map_values", "SELECT event_id, array_join(array_sort(map_values(map(event_type, props, 'x', 'y'))), '|') AS v FROM {events}", "SELECT event_id, array_to_string(list_sort([props, 'y']), '|') AS v FROM {events}")
R.pair("fn_list_filter", "SELECT p_partkey, array_join(transform(filter(sequence(1, p_size), x -> x % 7 = 0), x -> x * 2), ',') AS a, array_join(flatten(array(slice(split(p_name, ' '), 1, 1), array('z'))), ' ') AS f, size(concat(array(1), array(2, 3))) AS n FROM {part}", "SELECT p_partkey, coalesce(array_to_string(list_transform(list_filter(range(1, p_size + 1), lambda x: x % 7 = 0), lambda x: x * 2), ','), '') AS a, array_to_string(flatten([string_split(p_name, ' ')[1:1], ['z']]), ' ') AS f, CAST(len([1] || [2, 3]) AS INTEGER) AS n FROM {part}")
for _extra in ("fn_list_transform", "fn_list_flatten", "fn_list_range", "fn_list_slice", "fn_list_concat", "fn_list_len"):
    R.queries[_extra], R.oracles[_extra] = R.queries["fn_list_filter"], R.oracles["fn_list_filter"]
R.pair("fn_json_out", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS j FROM {nation}", "SELECT n_nationkey, CAST(to_json(struct_pack(name := n_name, region := n_regionkey)) AS VARCHAR) AS j FROM {nation}")
R.pair("fn_json_build", "SELECT n_regionkey, to_json(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> array(cast(x.n_nationkey AS string), x.n_name))) AS j, size(split('a;b', ';')) AS n FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list([CAST(n_nationkey AS VARCHAR), n_name] ORDER BY n_nationkey)) AS VARCHAR) AS j, CAST(len(string_split('a;b', ';')) AS INTEGER) AS n FROM {nation} GROUP BY n_regionkey")
R.pair("fn_json_get", "SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'map<string,string>')['nope'] AS none FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none FROM {events}")

QUERIES, ORACLES = R.queries, R.oracles
