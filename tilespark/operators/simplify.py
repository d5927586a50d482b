"""What each layer shows at each level, before it is cut into tiles.

A feature is simplified once for each level, not once for each tile: the result does not depend on the tile. Filters that
need no geometry come first, since Catalyst moves nothing across a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import simplify_once
from ..functions.lod import poi_visible, road_visible, road_width
from ..functions.project import box_area, box_diagonal


def at_levels(features: DataFrame, lods: DataFrame) -> DataFrame:
    """Features times levels; the levels are a few dozen rows at most."""
    return features.crossJoin(F.broadcast(lods))


def _simplified(rows: DataFrame, layer: str) -> DataFrame:
    shape = simplify_once("xs", "ys", F.lit(layer), "lod", "epsilon", "snap_m")
    rows = rows.withColumn("shape", shape).filter(F.col("shape.xs").isNotNull())
    return rows.withColumns({"xs": F.col("shape.xs"), "ys": F.col("shape.ys")}).drop("shape").withColumns({
        "box_x0": F.array_min("xs"), "box_y0": F.array_min("ys"), "box_x1": F.array_max("xs"), "box_y1": F.array_max("ys")})


def _box(f):
    return f(F.col("box_x0"), F.col("box_y0"), F.col("box_x1"), F.col("box_y1"))


def simplify_areas(areas: DataFrame, lods: DataFrame) -> DataFrame:
    rows = _simplified(at_levels(areas, lods), "area")
    return rows.filter((F.col("lod") == 0) | (_box(box_area) >= F.col("min_area_box")))


def simplify_buildings(buildings: DataFrame, lods: DataFrame) -> DataFrame:
    """Without the merging of dense ones, which depends on the tile."""
    return _simplified(at_levels(buildings, lods), "building").filter(_box(box_area) >= F.col("min_building_box"))


def simplify_roads(roads: DataFrame, lods: DataFrame) -> DataFrame:
    rows = at_levels(roads, lods).filter(road_visible(F.col("road_class"), F.col("lod")))
    rows = _simplified(rows, "road").filter((F.col("lod") == 0) | (_box(box_diagonal) >= F.col("min_road_diagonal")))
    return rows.withColumn("width_m", road_width(F.col("width_m"), F.col("lod")))


def simplify_pois(pois: DataFrame, lods: DataFrame) -> DataFrame:
    return at_levels(pois, lods).filter(poi_visible(F.col("kind"), F.col("lod")))
