"""The whole build: raw tables in, published tables out. Tables that several steps read are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.latin import latin_names, place_latin_names
from ..operators.tables import written
from . import steps as S


def build(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    stops = written(S.polish_stops(raw["stops"], raw["countries"]), "stops")
    rels = written(raw["rels"], "rels")
    members = written(S.rel_members(rels), "members")
    calls, lines = written(S.route_calls(rels), "calls"), written(S.line_routes(rels), "lines")
    in_areas = written(members.where("is_stop_area"), "in-areas")  # few of the members; the steps on stop areas read no others
    groups = written(S.area_group(in_areas, stops), "groups")
    modes = written(S.stop_modes(stops), "modes")
    # each of these steps reads the objects several times
    objects = written(S.station_objects(stops, modes, in_areas, groups), "objects")
    objects = written(S.shared_metro(objects, modes), "objects")
    objects = written(S.untagged_positions(objects, stops, modes, in_areas, groups), "objects")
    objects = written(S.areas_without_stop(objects, rels), "objects")
    objects = S.merge_groups(objects, S.near_duplicates(S.named_groups(objects, rels)))
    objects = written(S.bus_stations(written(S.attach_strays(objects), "objects")), "objects")
    st = S.lift_ends(S.stations(objects, rels, groups), objects, raw["line_ways"])
    st = written(S.weights(S.station_keys(st), calls, rels, objects), "stations")
    overrides = written(S.city_overrides(raw["boundaries"], raw["overrides"]), "overrides")
    st = written(S.country_region_city(st, raw["boundaries"], overrides, raw["countries"]), "stations")
    st = written(S.settlements(st, raw["places"], raw["boundaries"]), "stations")
    st = S.station_tracks(S.station_lines(st, objects, S.line_calls(rels)), objects, S.platform_stops(st, objects))
    st = written(S.lift_lines(written(st, "stations"), raw["line_ways"], raw["ski_areas"]), "stations")
    st = written(place_latin_names(latin_names(st)), "stations")
    st = written(S.needs_place(st, raw["boundaries"], overrides, raw["places"]), "stations")
    names = S.fold_column(S.search_names(st, objects, rels))
    return {"stations": st, "station_objects": objects, "station_names": names, "rel_members": members, "route_stops": calls.drop("route"), "line_routes": lines, "rels": rels, "stops": stops}
