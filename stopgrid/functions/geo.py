"""Geometry. Points are two double columns (lon, lat); lines and polygons are arrays of points or rings.

Four models of distance are kept apart, as their results differ: the sphere of radius 6371008.8 m (dist_m), the sphere of 6371000 m
(metres), the WGS 84 spheroid (geodesic) and plain degrees (planar).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii, the spheroid, metres for each degree of a rough projection, and degrees that surely hold a metre up to 78°.
MEAN_RADIUS, ROUND_RADIUS = 6371008.8, 6371000.0
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563
LON_METRES, LAT_METRES = 111320.0, 110540.0
METRES_PER_DEGREE = 22264.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def dist_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine(lon1, lat1, lon2, lat2, MEAN_RADIUS)


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine(lon1, lat1, lon2, lat2, ROUND_RADIUS)


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt(F.pow(lon1 - lon2, F.lit(2.0)) + F.pow(lat1 - lat2, F.lit(2.0)))


def equirect(lon: Column, lat: Column, true_metres: bool = False) -> tuple[Column, Column]:
    """x and y of a rough projection. As it is used for keys, x takes each point's own latitude, which shears it away from Greenwich;
    with true_metres, x only differs by longitude, at the latitude's nearest whole degree."""
    at = F.round(lat) if true_metres else lat
    return lon * LON_METRES * F.cos(F.radians(at)), lat * LAT_METRES


def geodesic_np(lon1, lat1, lon2, lat2) -> np.ndarray:  # noqa: ANN001
    """Metres on the WGS 84 spheroid, by Vincenty's inverse formula; nearly antipodal points, where it doesn't settle, on the sphere."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    b = WGS_A * (1 - WGS_F)
    u1, u2, lam0 = np.arctan((1 - WGS_F) * np.tan(lat1)), np.arctan((1 - WGS_F) * np.tan(lat2)), lon2 - lon1
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lam0.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            s, c = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * s, cu1 * su2 - su1 * cu2 * c)
            cs = su1 * su2 + cu1 * cu2 * c
            sig = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * s / ss, 0)
            ca = 1 - sa * sa
            cm = np.where(ca > 0, cs - 2 * su1 * su2 / ca, 0)
            k = WGS_F / 16 * ca * (4 + WGS_F * (4 - 3 * ca))
            new = lam0 + (1 - k) * WGS_F * sa * (sig + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        uu = ca * (WGS_A**2 - b * b) / (b * b)
        aa = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
        bb = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
        ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        out = b * aa * (sig - ds)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(lam0 / 2) ** 2
    return np.where(done & np.isfinite(out), out, 2 * MEAN_RADIUS * np.arcsin(np.sqrt(np.minimum(1, h))))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geodesic_np(a, b, c, d))

    return run(lon1, lat1, lon2, lat2)


# --- lines and polygons: array<struct<lon, lat>> and array<array<struct<lon, lat>>>, as sums over neighbouring points

POINT = "struct<lon:double,lat:double>"


def start_point(path: Column) -> Column:
    return F.get(path, F.lit(0))


def end_point(path: Column) -> Column:
    return F.get(path, F.size(path) - 1)


def segments(path: Column) -> Column:
    """array<struct<a, b>> of a path's neighbouring points."""
    n = F.size(path)
    return F.arrays_zip(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def ring_area(ring: Column) -> Column:
    """Signed, in square degrees."""
    return _sum(F.transform(segments(ring), lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])) / 2


def area(rings: Column) -> Column:
    """Of a polygon in square degrees: the first ring less the others."""
    each = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return 2 * F.coalesce(F.get(each, F.lit(0)), F.lit(0.0)) - _sum(each)


def path_length(path: Column) -> Column:
    return _sum(F.transform(segments(path), lambda s: planar(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))


def path_centroid(path: Column) -> Column:
    """The middle of a line: its segments' middles weighed by their lengths; of a line without length, its first point."""
    def long(s: Column) -> Column:
        return planar(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])

    total = path_length(path)
    mean = lambda k: _sum(F.transform(segments(path), lambda s: (s["a"][k] + s["b"][k]) / 2 * long(s))) / total
    return F.when(total > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))).otherwise(start_point(path))


def closest_on(s: Column, lon: Column, lat: Column) -> Column:
    """The point of a segment nearest in degrees, and its squared distance: struct<d2, lon, lat>."""
    dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - s["a"]["lon"]) * dx + (lat - s["a"]["lat"]) * dy) / long))).otherwise(0.0)
    x, y = s["a"]["lon"] + t * dx, s["a"]["lat"] + t * dy
    return F.struct((F.pow(lon - x, F.lit(2.0)) + F.pow(lat - y, F.lit(2.0))).alias("d2"), x.alias("lon"), y.alias("lat"))


def closest_point(path: Column, lon: Column, lat: Column) -> Column:
    """struct<d2, lon, lat> of the path's point nearest in degrees."""
    return F.array_min(F.transform(segments(path), lambda s: closest_on(s, lon, lat)))


def interpolate(path: Column, share: float) -> Column:
    """The point at a share of the line's length in degrees."""
    want = path_length(path) * share
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast(POINT).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        long = planar(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])
        t = F.when(long > 0, (want - acc["gone"]) / long).otherwise(0.0)
        here = F.struct((s["a"]["lon"] + t * (s["b"]["lon"] - s["a"]["lon"])).alias("lon"), (s["a"]["lat"] + t * (s["b"]["lat"] - s["a"]["lat"])).alias("lat"))
        return F.struct((acc["gone"] + long).alias("gone"), F.when(acc["at"].isNull() & (acc["gone"] + long >= want), here).otherwise(acc["at"]).alias("at"))

    return F.coalesce(F.aggregate(segments(path), start, step, lambda acc: acc["at"]), end_point(path))


def _edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, segments))


def on_border(rings: Column, lon: Column, lat: Column) -> Column:
    return F.exists(_edges(rings), lambda s: closest_on(s, lon, lat)["d2"] == 0)


def contains(rings: Column, lon: Column, lat: Column, border: bool = False) -> Column:
    """Whether a polygon holds a point, by the parity of crossings; the border counts only if asked for."""
    cross = F.filter(_edges(rings), lambda s: ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)) & (lon < (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lon"]))
    edge = on_border(rings, lon, lat)
    inside = F.size(cross) % 2 == 1
    return inside | edge if border else inside & ~edge


def polygon_distance(rings: Column, lon: Column, lat: Column) -> Column:
    """Degrees from a point to a polygon, 0 inside."""
    return F.when(contains(rings, lon, lat, True), 0.0).otherwise(F.sqrt(F.array_min(F.transform(_edges(rings), lambda s: closest_on(s, lon, lat)["d2"]))))


def bbox(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return {"x0": F.array_min(lons), "x1": F.array_max(lons), "y0": F.array_min(lats), "y1": F.array_max(lats)}


def beyond(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """What of a ring is on one side of a line (its points may be on it), closed; empty where nothing is. Stretches along the line join what
    was apart, which changes neither areas nor crossings."""
    other = "lat" if axis == "lon" else "lon"
    kept = (lambda p: p[axis] >= bound) if above else (lambda p: p[axis] <= bound)

    def met(s: Column) -> Column:
        t = (bound - s["a"][axis]) / (s["b"][axis] - s["a"][axis])
        at = {axis: bound, other: s["a"][other] + t * (s["b"][other] - s["a"][other])}
        return F.struct(at["lon"].alias("lon"), at["lat"].alias("lat"))

    def left(s: Column) -> Column:
        crossed = F.when(kept(s["a"]) != kept(s["b"]), met(s))
        return F.array_compact(F.array(crossed, F.when(kept(s["b"]), s["b"])))

    points = F.flatten(F.transform(segments(ring), left))
    return F.transform(F.array(points), lambda own: F.concat(own, F.slice(own, 1, 1)))[0]  # one value, worked out once


def strip(rings: Column, axis: str, low: Column, high: Column) -> Column:
    """The rings between two lines; those with nothing there are left out."""
    cut = F.transform(rings, lambda r: beyond(beyond(r, axis, low, True), axis, high, False))
    return F.filter(cut, lambda r: F.size(r) > 3)


def n_points(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def degrees_for(m: float) -> float:
    return m / METRES_PER_DEGREE


def lat_degrees(m: float) -> float:
    """Degrees of latitude that surely hold m metres on the sphere."""
    return math.degrees(m / MEAN_RADIUS) * (1 + 1e-9) + 1e-12


def lon_degrees(m: float, tall: float, band: Column) -> Column:
    """Degrees of longitude that surely hold m metres between points of a band of latitude (``tall`` degrees high) and of those beside it; near the poles, all."""
    least = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(tall))))
    half = F.lit(math.sin(min(m / (2 * MEAN_RADIUS), math.pi / 2))) / least
    return F.when((least <= 0) | (half >= 1), 360.0).otherwise(F.degrees(F.asin(half)) * (2 * (1 + 1e-9)) + 1e-12)


def box_degrees(radius: float) -> float:
    """Half the side of a box around a point that holds a radius in metres up to 70°."""
    return radius / LON_METRES * 3
