"""What a tagged element is: expressions over ``array<struct<k,v>>``, whose order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PLACES, ROAD_CLASS, ROAD_HIGHWAYS, ROAD_WIDTH_M, TERRAIN, TERRAIN_PRIORITY, TERRAIN_TAGS


def terrain_of(k: Column, v: Column) -> Column:
    """Terrain code of one tag, or null."""
    out = None
    for name, keys in TERRAIN_TAGS.items():
        for key, values in keys.items():
            test = (k == key) if values == ["*"] else (k == key) & v.isin(values)
            out = F.when(test, TERRAIN[name]) if out is None else out.when(test, TERRAIN[name])
    return out


def terrain_priority(code: Column) -> Column:
    out = None
    for name, rank in TERRAIN_PRIORITY.items():
        out = F.when(code == TERRAIN[name], rank) if out is None else out.when(code == TERRAIN[name], rank)
    return out


def best_terrain(tags: Column) -> Column:
    """Terrain code of the highest priority among the tags, or null."""
    ranked = F.transform(tags, lambda t: F.struct(terrain_priority(terrain_of(t["k"], t["v"])).alias("rank"), terrain_of(t["k"], t["v"]).alias("code")))
    return F.array_max(F.filter(ranked, lambda r: r["code"].isNotNull()))["code"]


def has_tag(tags: Column, k: str, v: str | None = None) -> Column:
    return F.coalesce(F.exists(tags, lambda t: (t["k"] == k) if v is None else (t["k"] == k) & (t["v"] == v)), F.lit(False))


def last_value(tags: Column, k: str) -> Column:
    return F.try_element_at(F.filter(tags, lambda t: t["k"] == k), F.lit(-1))["v"]


def _by_highway(highway: Column, values: dict) -> Column:
    out = None
    for name, highways in ROAD_HIGHWAYS.items():
        out = F.when(highway.isin(highways), values[name]) if out is None else out.when(highway.isin(highways), values[name])
    return out


def road_class_of(highway: Column, is_area: Column) -> Column:
    """Road class code, or null for areas and for highways that are no road."""
    return F.when(~is_area, _by_highway(highway, ROAD_CLASS))


def road_width_of(highway: Column, is_area: Column) -> Column:
    return F.when(~is_area, _by_highway(highway, ROAD_WIDTH_M))


def way_kind(tags: Column) -> Column:
    """struct<layer,terrain,road_class,width_m>: a building whatever its value, else a road, else an area; null if none."""
    highway, is_area = last_value(tags, "highway"), has_tag(tags, "area", "yes")
    road, terrain, building = road_class_of(highway, is_area), best_terrain(tags), has_tag(tags, "building")
    layer = F.when(building, "building").when(road.isNotNull(), "road").when(terrain.isNotNull(), "area")
    fields = F.struct(
        layer.alias("layer"), F.when(layer == "area", terrain).cast("int").alias("terrain"), F.when(layer == "road", road).cast("int").alias("road_class"),
        F.when(layer == "road", road_width_of(highway, is_area)).cast("double").alias("width_m"),
    )
    return F.when(layer.isNotNull(), fields)


def relation_terrain(tags: Column) -> Column:
    """Terrain code of a multipolygon relation, or null."""
    return F.when(has_tag(tags, "type", "multipolygon"), best_terrain(tags))


def poi_kind(tags: Column) -> Column:
    """``key:value`` of the first tag that makes a point of interest, or null."""
    kinds = F.transform(tags, lambda t: F.when(
        t["k"].isin("amenity", "tourism") | ((t["k"] == "railway") & (t["v"] == "station")) | ((t["k"] == "aeroway") & (t["v"] == "aerodrome")) | ((t["k"] == "place") & t["v"].isin(PLACES)),
        F.concat(t["k"], F.lit(":"), t["v"])))
    return F.get(F.filter(kinds, lambda x: x.isNotNull()), F.lit(0))


def poi_name(tags: Column) -> Column:
    return last_value(tags, "name")


def is_closed_way(refs: Column) -> Column:
    """At least four refs, the last one the first."""
    return (F.size(refs) >= 4) & (F.get(refs, F.lit(0)) == F.try_element_at(refs, F.lit(-1)))


def is_open_way(refs: Column) -> Column:
    return F.size(refs) >= 2


def outer_members(members: Column) -> Column:
    """Members of type way whose role is outer or empty; inner rings are not used."""
    return F.filter(members, lambda m: (m["type"] == "way") & m["role"].isin("outer", ""))
