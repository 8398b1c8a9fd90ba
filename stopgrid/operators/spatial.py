"""Spatial joins as equi joins on grid cells, so no nested loop over all pairs is ever planned.

One side is put in the cell of its point; the other in every cell that its reach touches; then exact distances or containment decide.
Hot cells are split by adaptive skew joins, as cells are ordinary join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .rel import first_per

#: Points up to which a polygon is met whole (fixed value of the outlines' cutting).
MOST_POINTS = 256


def around(x: Column, reach: float) -> Column:
    """The cells that [x - reach, x + reach] touches, for cells of size reach."""
    return F.sequence(geo.cell(x - F.lit(reach), reach), geo.cell(x + F.lit(reach), reach))


def grid_join(left: DataFrame, right: DataFrame, on: list[str], x: str, y: str, reach: float) -> DataFrame:
    """left's and right's rows with equal ``on`` and at most ``reach`` apart in the plane; right's other columns get the suffix _r."""
    a = left.withColumn("_cx", F.explode(around(F.col(x), reach))).withColumn("_cy", F.explode(around(F.col(y), reach)))
    b = right.select(*on, *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in on), geo.cell(F.col(x), reach).alias("_cx"), geo.cell(F.col(y), reach).alias("_cy"))
    met = a.join(b, [*on, "_cx", "_cy"]).drop("_cx", "_cy")
    return met.where(F.pow(F.col(x) - F.col(f"{x}_r"), F.lit(2.0)) + F.pow(F.col(y) - F.col(f"{y}_r"), F.lit(2.0)) <= reach * reach)


def within_join(left: DataFrame, right: DataFrame, m: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of points at most m metres apart on the sphere, with the metres in d. Both sides have lon and lat; right's columns get _r.
    Cells are bands of m metres of latitude, cut by the degrees of longitude that m metres are there; longitudes are not joined across the antimeridian.
    Points are dealt by their cells, so that a small file's join isn't one task's."""
    on = on or []
    tall = geo.lat_degrees(m)
    a = left.withColumn("_cy", F.explode(around(F.col("lat"), tall))).withColumn("_w", geo.lon_degrees(m, tall, F.col("_cy")))
    at = lambda d: F.floor((F.col("lon") + d) / F.col("_w")).cast("long")
    a = a.withColumn("_cx", F.explode(F.sequence(at(-F.col("_w")), at(F.col("_w"))))).drop("_w").repartition(*on, "_cx", "_cy")
    b = right.withColumn("_cy", geo.cell(F.col("lat"), tall)).withColumn("_w", geo.lon_degrees(m, tall, F.col("_cy"))).withColumn("_cx", at(F.lit(0.0)))
    b = b.select(*on, *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in on), "_cx", "_cy")
    d = geo.dist_m(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r"))
    return a.join(b, [*on, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d", d).where(F.col("d") <= m)


def nearest_within(left: DataFrame, right: DataFrame, m: float, key: list[str], tie: list[str], on: list[str] | None = None) -> DataFrame:
    """within_join, of each key (one row of left) only the nearest, of equally near ones the least by ``tie``. An eighth of the reach comes first:
    who has a neighbour there has no nearer one beyond, so where points are dense few pairs are made."""
    from .tables import written

    left, first = written(left, "near-left"), lambda met: first_per(met, key, [F.col("d"), *map(F.col, tie)])
    close = written(first(within_join(left, right, m / 8, on)), "near")
    return close.unionByName(first(within_join(left.join(close.select(*key), key, "left_anti"), right, m, on)))


def grid_cells(left: DataFrame, right: DataFrame, on: list[str], reach: float) -> DataFrame:
    a = left.withColumn("_cx", F.explode(around(F.col("lon"), reach))).withColumn("_cy", F.explode(around(F.col("lat"), reach)))
    b = right.select(*on, *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in on), geo.cell(F.col("lon"), reach).alias("_cx"), geo.cell(F.col("lat"), reach).alias("_cy"))
    return a.repartition(*on, "_cx", "_cy").join(b, [*on, "_cx", "_cy"]).drop("_cx", "_cy")


def knn(queries: DataFrame, points: DataFrame, key: str | list[str], k: int, reach: float, on: list[str] | None = None, tie: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The k points nearest in degrees to each query point within a box of half side reach, ranked in _rank; with ``whole``, within all of ``on``.

    Boxes grow from reach / 64: who has k points at most as far as a box's half side has its nearest, and is done. So where points are
    dense few pairs are made, and the full reach is only searched for the others.
    """
    from .tables import written

    on, keys = on or [], [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy("_deg", *(tie or []))

    def ranked(left: DataFrame, box: float | None) -> DataFrame:
        if box is None:
            right = points.select(*on, *(F.col(c).alias(f"{c}_r") for c in points.columns if c not in on))
            met = left.join(right, on) if on else left.crossJoin(right)
        else:
            met = grid_cells(left, points, on, box).where((F.abs(F.col("lon") - F.col("lon_r")) <= box) & (F.abs(F.col("lat") - F.col("lat_r")) <= box))
        met = met.withColumn("_deg", geo.planar(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r")))
        return met.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)

    left, found = written(queries, "asked"), []
    for box in (reach / 64, reach / 16, reach / 4, *((reach,) if whole else ())):
        near = written(ranked(left, box), "nearest")
        done = near.where((F.col("_rank") == k) & (F.col("_deg") <= box)).select(*keys)
        found.append(near.join(done, keys, "left_semi"))
        left = written(left.join(done, keys, "left_anti"), "asked")
        if not left.limit(1).count():
            break
    else:
        found.append(ranked(left, None if whole else reach))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mutual_nearest(a: DataFrame, b: DataFrame, group: str, key_a: str, key_b: str, most: float, ratio: float) -> DataFrame:
    """Pairs of a group that are each other's nearest (in degrees), at most ``most`` metres apart, the second nearest at least ``ratio`` times as far.
    Each side's nearest are searched by growing boxes, not among all pairs of the group."""
    reach = geo.degrees_for(most * ratio)
    two = knn(a, b, [group, key_a], 2, reach, [group], [f"{key_b}_r"], whole=True).withColumnRenamed(f"{key_b}_r", key_b)
    two = two.withColumn("d", geo.dist_m(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r")))
    two = two.withColumn("_next", F.lead("d").over(Window.partitionBy(group, key_a).orderBy("_rank"))).where("_rank = 1").drop("_rank", "_deg")
    back = knn(b, a, [group, key_b], 1, reach, [group], [f"{key_a}_r"], whole=True).select(group, key_b, F.col(f"{key_a}_r").alias(key_a))
    return two.join(back, [group, key_a, key_b]).where((F.col("d") <= most) & (F.col("_next").isNull() | (F.col("_next") >= ratio * F.col("d")))).drop("_next")


def polygon_cells(polygons: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """Each polygon in every cell that its bounding box touches."""
    box = geo.bbox(F.col(rings))
    xs = F.sequence(geo.cell(box["x0"], size), geo.cell(box["x1"], size))
    ys = F.sequence(geo.cell(box["y0"], size), geo.cell(box["y1"], size))
    return polygons.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def clipped_cells(polygons: DataFrame, size: float, most: int = MOST_POINTS, rings: str = "rings") -> DataFrame:
    """polygon_cells, but of a polygon with over ``most`` points each cell holds only what is in it (and a margin, so that no point of
    the cell is on a cut): first strips of longitude, then their cells. So a cell's row is as long as the outline is there."""
    small = F.col("_n") <= most
    margin = size / 1024
    r = F.col(rings)
    across = lambda c, axis: F.when(small, r).otherwise(geo.strip(r, axis, F.col(c) * size - margin, (F.col(c) + 1) * size + margin))
    sized = polygons.withColumn("_n", geo.n_points(r))
    box = geo.bbox(r)
    strips = sized.withColumn("_cx", F.explode(F.sequence(geo.cell(box["x0"], size), geo.cell(box["x1"], size))))
    strips = strips.withColumn(rings, across("_cx", "lon")).where(F.size(rings) > 0)
    cells = strips.withColumn("_cy", F.explode(F.sequence(geo.cell(box["y0"], size), geo.cell(box["y1"], size))))
    return cells.withColumn(rings, across("_cy", "lat")).where(F.size(rings) > 0).drop("_n")


def subdivide(polygons: DataFrame, most: int = MOST_POINTS, rings: str = "rings") -> DataFrame:
    """Polygons in pieces of at most ``most`` points: halves of the longer side of their box, again while any is larger."""
    from .tables import written

    done, left = None, polygons
    r = F.col(rings)
    while True:
        left = written(left.withColumn("_n", geo.n_points(r)), "pieces")
        small = left.where(F.col("_n") <= most).drop("_n")
        done = small if done is None else done.unionByName(small)
        large = left.where(F.col("_n") > most).drop("_n")
        if not large.limit(1).count():
            return done
        box = geo.bbox(r)
        boxed = large.select("*", *(v.alias(f"_{k}") for k, v in box.items()))
        wide = (F.col("_x1") - F.col("_x0")) >= (F.col("_y1") - F.col("_y0"))
        half = lambda axis, above: F.filter(F.transform(r, lambda x: geo.beyond(x, axis, F.col("_mid"), above)), lambda x: F.size(x) > 3)
        boxed = boxed.withColumn("_mid", F.when(wide, (F.col("_x0") + F.col("_x1")) / 2).otherwise((F.col("_y0") + F.col("_y1")) / 2))
        halves = F.explode(F.when(wide, F.array(half("lon", False), half("lon", True))).otherwise(F.array(half("lat", False), half("lat", True))))
        left = boxed.withColumn("_half", halves).where(F.size("_half") > 0).withColumn(rings, F.col("_half")).select(*polygons.columns)


def contains_join(points: DataFrame, polygons: DataFrame, size: float = 0.25, border: bool = False) -> DataFrame:
    """points (lon, lat) inside polygons (rings)."""
    p = points.withColumn("_cx", geo.cell(F.col("lon"), size)).withColumn("_cy", geo.cell(F.col("lat"), size))
    met = p.join(clipped_cells(polygons, size), ["_cx", "_cy"]).drop("_cx", "_cy")
    return met.where(geo.contains(F.col("rings"), F.col("lon"), F.col("lat"), border)).drop("rings")


def line_join(points: DataFrame, lines: DataFrame, m: float) -> DataFrame:
    """points (lon, lat) at most m metres from lines (path): adds d and the line's closest point (near). Lines are met by the cells of their segments."""
    reach = geo.degrees_for(m)
    size = max(reach, 0.01)
    seg = F.explode(geo.segments(F.col("path"))).alias("s")
    cut = lines.select(*lines.columns, seg)
    lo = lambda k: F.least(F.col(f"s.a.{k}"), F.col(f"s.b.{k}")) - reach
    hi = lambda k: F.greatest(F.col(f"s.a.{k}"), F.col(f"s.b.{k}")) + reach
    cells = cut.withColumn("_cx", F.explode(F.sequence(geo.cell(lo("lon"), size), geo.cell(hi("lon"), size)))).withColumn("_cy", F.explode(F.sequence(geo.cell(lo("lat"), size), geo.cell(hi("lat"), size))))
    cells = cells.drop("s").dropDuplicates(["way_id", "_cx", "_cy"])
    met = points.withColumn("_cx", geo.cell(F.col("lon"), size)).withColumn("_cy", geo.cell(F.col("lat"), size)).join(cells, ["_cx", "_cy"]).drop("_cx", "_cy")
    met = met.withColumn("near", geo.closest_point(F.col("path"), F.col("lon"), F.col("lat"))).where(F.sqrt("near.d2") <= reach)
    return met.withColumn("d", geo.dist_m(F.col("near.lon"), F.col("near.lat"), F.col("lon"), F.col("lat"))).where(F.col("d") <= m)


def near_polygons(points: DataFrame, polygons: DataFrame, m: float) -> DataFrame:
    """points (lon, lat) at most m metres from polygons (rings) or inside, in degrees scaled by the point's latitude (up to 80°)."""
    limit = F.lit(float(m)) / (F.lit(geo.LON_METRES) * F.cos(F.radians(F.col("lat"))))
    most = m / (geo.LON_METRES * 0.17)
    size = max(0.05, most)
    box = geo.bbox(F.col("rings"))
    xs = F.sequence(geo.cell(box["x0"] - most, size), geo.cell(box["x1"] + most, size))
    ys = F.sequence(geo.cell(box["y0"] - most, size), geo.cell(box["y1"] + most, size))
    cells = polygons.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
    met = points.withColumn("_cx", geo.cell(F.col("lon"), size)).withColumn("_cy", geo.cell(F.col("lat"), size)).join(cells, ["_cx", "_cy"]).drop("_cx", "_cy")
    return met.where(geo.polygon_distance(F.col("rings"), F.col("lon"), F.col("lat")) <= limit)
