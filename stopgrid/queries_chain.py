"""SQL of the build's second half over the adapters' tables: each step as a view on the one before, in the order of ``plans.build``.

The adapters' names have no quays, poles, line suffixes or towns, so views say nothing of how those are stripped; tests hold that to
hand-made cases.
"""

from __future__ import annotations

from .plans import adapters as A

HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
DEG = "sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2))"
ENDS = ", ".join(f"({i}, '{n}', 'lower', {ax}, {ay}), ({i}, '{n}', 'upper', {bx}, {by})" for i, kind, n, ax, ay, bx, by in A.LIFTS if kind == "aerialway")


def views(rectangles: str, places: str) -> dict[str, str]:
    return {
        "o1": "(SELECT *, key AS source_key FROM obj UNION ALL SELECT s.mode, s.key, o.* EXCLUDE (mode, key, is_primary), true, s.key FROM shared s JOIN obj o ON o.mode = 'metro' AND o.osm_id = s.osm_id AND o.key = s.key)",
        "o3": """(SELECT * FROM o1 UNION ALL SELECT a.mode, a.key, s.*, false, a.key FROM (SELECT DISTINCT o.mode, o.key, m.osm_id FROM (SELECT DISTINCT mode, key FROM o1 WHERE starts_with(key, 'A')) o
            JOIN grp g ON o.key = 'A' || g.group_id JOIN me m ON m.relation_id = g.relation_id) a JOIN st s ON s.osm_id = a.osm_id WHERE s.osm_id NOT IN (SELECT osm_id FROM modes))""",
        "named3": "(SELECT DISTINCT ON (o.mode, o.key) o.mode, o.key, trim(regexp_replace(lower(coalesce(o.name, r.name)), '[^a-z0-9]+', ' ', 'g')) AS name, o.lon * 111320 * cos(radians(o.lat)) AS x, o.lat * 110540 AS y FROM o3 o LEFT JOIN re r ON o.key = 'A' || r.relation_id WHERE o.is_primary ORDER BY o.mode, o.key, (o.name IS NOT NULL) DESC, o.osm_id)",
        "pairs3": "(SELECT a.mode, a.key AS a, b.key AS b FROM named3 a JOIN named3 b ON a.mode = b.mode AND a.name = b.name AND a.key < b.key AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 160000 WHERE a.name <> '')",
        "sym3": "(SELECT mode, a, b FROM pairs3 UNION SELECT mode, b, a FROM pairs3)",
        "chain3(mode, a, b) USING KEY (mode, a)": "(SELECT DISTINCT mode, a, a FROM sym3 UNION (SELECT s.mode, s.a, min(c.b) FROM sym3 s JOIN chain3 c ON c.mode = s.mode AND c.a = s.b JOIN recurring.chain3 o ON o.mode = s.mode AND o.a = s.a WHERE c.b < o.b GROUP BY s.mode, s.a))",
        "o4": "MATERIALIZED (SELECT o.* REPLACE (coalesce(c.b, o.key) AS key) FROM o3 o LEFT JOIN chain3 c ON c.mode = o.mode AND c.a = o.key)",
        "stray": f"(SELECT DISTINCT ON (a.mode, a.key) a.mode, a.key, b.key AS moved FROM (SELECT DISTINCT ON (mode, key) * FROM o4 WHERE (mode, key) NOT IN (SELECT (mode, key) FROM o4 WHERE is_primary) ORDER BY mode, key, osm_id) a JOIN o4 b ON b.mode = a.mode AND b.is_primary WHERE {HAV} <= 400 ORDER BY a.mode, a.key, {HAV}, b.key)",
        "o5": "MATERIALIZED (SELECT o.* REPLACE (coalesce(s.moved, o.key) AS key) FROM o4 o LEFT JOIN stray s ON s.mode = o.mode AND s.key = o.key)",
        "hall": f"(SELECT DISTINCT ON (a.key) a.key, b.key AS moved FROM (SELECT * FROM o5 WHERE mode = 'bus' AND is_primary AND key NOT IN (SELECT key FROM o5 WHERE mode = 'bus' AND is_primary AND amenity = 'bus_station')) a, (SELECT DISTINCT ON (key) * FROM o5 WHERE mode = 'bus' AND is_primary AND amenity = 'bus_station' ORDER BY key, osm_id) b WHERE {HAV} <= 80 ORDER BY a.key, {HAV}, b.key)",
        "o6": "MATERIALIZED (SELECT o.* REPLACE (coalesce(h.moved, o.key) AS key) FROM o5 o LEFT JOIN hall h ON o.mode = 'bus' AND h.key = o.key)",
        "rep": "(SELECT DISTINCT ON (mode, key) * FROM o6 WHERE is_primary ORDER BY mode, key, coalesce(amenity = 'bus_station', false) DESC, (name IS NOT NULL) DESC, osm_id)",
        "sized": "(SELECT mode, key, count(*) AS n, max(wikidata) AS wikidata, max(uic_ref) AS uic_ref FROM o6 GROUP BY mode, key)",
        "areas6": "(SELECT o.mode, o.key, count(DISTINCT g.relation_id) AS n FROM (SELECT DISTINCT mode, key, source_key FROM o6 WHERE starts_with(source_key, 'A')) o JOIN grp g ON o.source_key = 'A' || g.group_id GROUP BY o.mode, o.key)",
        "own": """(SELECT CAST(row_number() OVER (ORDER BY r.mode, r.key) AS INTEGER) AS station_id, r.mode, r.key, r.osm_type, r.osm_id, coalesce(r.name, x.name) AS name, s.wikidata, s.uic_ref, r.lon, r.lat, s.n + coalesce(a.n, 0) AS n_objects,
            ln(1.0 + s.n + coalesce(a.n, 0)) + CASE WHEN s.wikidata IS NOT NULL THEN 0.5 ELSE 0 END AS weight
            FROM rep r JOIN sized s USING (mode, key) LEFT JOIN areas6 a USING (mode, key) LEFT JOIN re x ON r.key = 'A' || x.relation_id WHERE coalesce(r.name, x.name) IS NOT NULL)""",
        "ends": f"(SELECT * FROM (VALUES {ENDS}) AS t(way_id, name, lift_end, lon, lat))",
        "free": f"(SELECT * FROM ends a WHERE NOT EXISTS (SELECT 1 FROM o6 b WHERE b.mode = 'aerialway' AND b.is_primary AND b.name IS NOT NULL AND {HAV} <= 60) AND NOT EXISTS (SELECT 1 FROM ends b WHERE b.way_id <> a.way_id AND b.name = a.name AND {HAV} <= 5))",
        "lifts": "(SELECT CAST((SELECT max(station_id) FROM own) + row_number() OVER (ORDER BY way_id, lift_end) AS INTEGER) AS station_id, 'aerialway' AS mode, 'L' || way_id || lift_end AS key, 'W' AS osm_type, CAST(way_id AS BIGINT) AS osm_id, name, CAST(NULL AS VARCHAR) AS wikidata, CAST(NULL AS VARCHAR) AS uic_ref, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, 1 AS n_objects, ln(2.0) AS weight, 'W' || way_id || ':' || lift_end AS station_key, lift_end FROM free)",
        "choice": "(SELECT station_id, mode, 1 AS p, wikidata AS c FROM own WHERE regexp_matches(wikidata, '^Q[0-9]+$') UNION ALL SELECT station_id, mode, 2, 'UIC' || trim(uic_ref) FROM own WHERE trim(uic_ref) <> '' UNION ALL SELECT station_id, mode, 3, osm_type || osm_id FROM own)",
        "keyed": "(SELECT station_id, arg_min(c, p) AS station_key FROM (SELECT *, count(*) OVER (PARTITION BY mode, c) AS held FROM choice) WHERE held = 1 GROUP BY station_id)",
        "stn": "MATERIALIZED (SELECT o.*, k.station_key, CAST(NULL AS VARCHAR) AS lift_end FROM own o LEFT JOIN keyed k USING (station_id) UNION ALL SELECT * FROM lifts)",
        "serves": f"(SELECT o.mode, o.key, count(DISTINCT c.relation_id) AS n FROM calls c JOIN re r USING (relation_id) JOIN (VALUES {', '.join(f'({m!r}, {r!r})' for m, r in (('metro', 'subway'), ('metro', 'light_rail'), ('metro', 'monorail'), ('tram', 'tram'), ('tram', 'light_rail'), ('train', 'train')))}) AS t(mode, route) USING (route) JOIN o6 o ON o.mode = t.mode AND o.osm_id = c.osm_id GROUP BY o.mode, o.key)",
        "box": f"(SELECT *, CASE relation_id WHEN 3 THEN 'Third' WHEN 4 THEN 'Fourth' ELSE name END AS city_name, relation_id IN (3, 4, 102) AS is_city FROM ({rectangles}))",
        "hits": "MATERIALIZED (SELECT s.station_id, b.* FROM stn s JOIN box b ON s.lon > b.x0 AND s.lon < b.x0 + b.w AND s.lat > b.y0 AND s.lat < b.y0 + b.h)",
        "sited": """MATERIALIZED (SELECT station_id, arg_min(name, relation_id) FILTER (WHERE admin_level = 4) AS region, bool_or(is_city) AS city_override,
            CASE WHEN bool_or(is_city) THEN arg_max(city_name, admin_level * 1000 + relation_id) FILTER (WHERE is_city) ELSE arg_max(name, admin_level * 1000 + relation_id) FILTER (WHERE admin_level BETWEEN 6 AND 8) END AS city,
            coalesce(array_to_string(list_sort(list(DISTINCT relation_id) FILTER (WHERE admin_level BETWEEN 4 AND 8 OR is_city)), ','), '') AS boundary_ids, max(CASE WHEN admin_level BETWEEN 6 AND 8 THEN admin_level * 1000 + relation_id END) AS muni, max(iso) FILTER (WHERE admin_level = 2) AS c FROM hits GROUP BY station_id)""",
        "settled": f"""(SELECT DISTINCT ON (a.station_id) a.station_id, b.name AS settlement, b.place FROM stn a LEFT JOIN sited s USING (station_id) JOIN ({places}) b ON {HAV} <= CASE b.place WHEN 'city' THEN 8000 WHEN 'town' THEN 4000 WHEN 'village' THEN 2000 ELSE 800 END
            WHERE s.muni IS NULL OR EXISTS (SELECT 1 FROM box x WHERE x.relation_id = s.muni % 1000 AND b.lon > x.x0 AND b.lon < x.x0 + x.w AND b.lat > x.y0 AND b.lat < x.y0 + x.h)
            ORDER BY a.station_id, (b.place = 'city') DESC, {HAV} / CASE b.place WHEN 'city' THEN 8000 WHEN 'town' THEN 4000 WHEN 'village' THEN 2000 ELSE 800 END, b.node_id)""",
        "held": "MATERIALIZED (SELECT s.station_id, s.lon AS st_lon, s.lat AS st_lat, o.* FROM stn s JOIN o6 o USING (mode, key))",
        "called": "(SELECT DISTINCT h.station_id, l.ref, h.osm_id, h.lon, h.lat, coalesce(h.public_transport = 'stop_position', false) AS on_track, l.colour FROM held h JOIN me m ON m.osm_id = h.osm_id JOIN lines l ON l.relation_id = m.relation_id AND l.mode = h.mode)",
        "called1": "(SELECT station_id, ref, osm_id, max(colour) AS colour, any_value(lon) AS lon, any_value(lat) AS lat, bool_or(on_track) AS on_track FROM called GROUP BY station_id, ref, osm_id)",
        "plat": "(SELECT * FROM held WHERE mode IN ('train', 'metro', 'tram', 'funicular') AND (public_transport = 'platform' OR railway = 'platform') AND regexp_matches(ref, '^[^;]+$'))",
        "spos": "(SELECT * FROM held WHERE mode IN ('train', 'metro', 'tram', 'funicular') AND public_transport = 'stop_position' AND ref IS NULL)",
        "near": f"(SELECT *, row_number() OVER (PARTITION BY station_id, a ORDER BY deg, b) AS ra, row_number() OVER (PARTITION BY station_id, b ORDER BY deg, a) AS rb, lead(d) OVER (PARTITION BY station_id, a ORDER BY deg, b) AS next FROM (SELECT a.station_id, a.osm_id AS a, b.osm_id AS b, b.lon, b.lat, {HAV} AS d, {DEG} AS deg FROM plat a JOIN spos b ON a.station_id = b.station_id))",
        "twin": "(SELECT station_id, 'N' AS osm_type, a AS osm_id, lon, lat FROM near WHERE ra = 1 AND rb = 1 AND d <= 30 AND (next IS NULL OR next >= 1.5 * d))",
        "tracks": """(SELECT DISTINCT ON (h.station_id, ref) h.station_id, ref, coalesce(t.lon, h.lon) AS lon, coalesce(t.lat, h.lat) AS lat, coalesce(h.public_transport = 'stop_position', false) OR t.lon IS NOT NULL AS on_track FROM held h LEFT JOIN twin t ON t.station_id = h.station_id AND t.osm_id = h.osm_id
            WHERE mode IN ('train', 'metro', 'tram', 'funicular') AND (public_transport IN ('stop_position', 'platform') OR railway = 'platform') AND ref IS NOT NULL
            ORDER BY h.station_id, ref, (coalesce(h.public_transport = 'stop_position', false) OR t.lon IS NOT NULL) DESC, sqrt(pow(coalesce(t.lon, h.lon) - st_lon, 2) + pow(coalesce(t.lat, h.lat) - st_lat, 2)), 3, 4)""",
    }
