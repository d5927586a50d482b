"""From map elements to tiles: scan, classify, resolve, simplify, tile, quantize, write, index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.grid import Grid
from ..functions.lod import Lod, lod_count, lod_table, total_chunks
from ..functions.project import mercator_x, mercator_y, quantize_points, quantized_bounds
from ..operators.dissolve import dissolve_dense
from ..operators.manifest import entity_counts, manifest_rows, recover_manifest, with_old_origin
from ..operators.resolve import member_segments, resolve_points, stitched_rings, with_envelope
from ..operators.simplify import simplify_areas, simplify_buildings, simplify_pois, simplify_roads
from ..operators.tiling import assign_tiles, selected_tiles
from ..schema import QUANTIZATION_SCALE
from ..sources import tiles as T
from ..sources.store import remove

ENVELOPE = ["min_x", "min_y", "max_x", "max_y"]
SHAPES = "feature_id bigint, ring_no int, terrain int, road_class int, width_m double, xs array<double>, ys array<double>, min_x double, min_y double, max_x double, max_y double, layer string"


@dataclass
class Scan:
    """What the bounds of all nodes settle."""

    lat_lon: tuple[float, float, float, float]
    mercator: tuple[float, float, float, float]
    grid: Grid
    chunks: int
    levels: list[Lod]


def scan_bounds(nodes: DataFrame, tile_size: int = 100_000) -> Scan:
    """One pass over all nodes, used or not. No node is an error."""
    x, y = mercator_x(F.col("lon")), mercator_y(F.col("lat"))
    b = nodes.agg(*(f(c).alias(f"{n}_{k}") for k, c in (("lat", F.col("lat")), ("lon", F.col("lon")), ("x", x), ("y", y)) for n, f in (("min", F.min), ("max", F.max)))).first()
    if b["min_x"] is None:
        raise ValueError("the source has no nodes")
    box = (b["min_x"], b["min_y"], b["max_x"], b["max_y"])
    chunks = total_chunks(max(box[2] - box[0], 0.0) * max(box[3] - box[1], 0.0))
    return Scan((b["min_lat"], b["min_lon"], b["max_lat"], b["max_lon"]), box, Grid.from_bounds(*box, tile_size), chunks, Lod.levels(lod_count(chunks)))


def resolve_shapes(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(feature_id, ring_no, layer, terrain, road_class, width_m, xs, ys and envelope) of areas, buildings and roads in
    mercator metres: one join with the nodes for all three.

    A way is what its tags say or nothing: one that fails the test of its layer does not fall through to another. A tagged
    way that is also an outer member makes two areas.
    """
    points = nodes.select("id", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"))
    kinds = ways.withColumn("kind", C.way_kind(F.col("tags"))).filter(F.col("kind").isNotNull()).select(F.col("id").alias("feature_id"), "refs", "kind.*")
    closed, open_ = C.is_closed_way(F.col("refs")), C.is_open_way(F.col("refs"))
    kept = kinds.filter(F.when(F.col("layer") == "road", open_).otherwise(closed))
    area_relations = relations.withColumn("terrain", C.relation_terrain(F.col("tags"))).filter(F.col("terrain").isNotNull() & (F.size(C.outer_members(F.col("members"))) > 0))
    rings = stitched_rings(member_segments(area_relations, ways)).join(area_relations.select(F.col("id").alias("rel_id"), "terrain"), "rel_id")
    rings = rings.select((-F.col("rel_id")).alias("feature_id"), "ring_no", "refs", "terrain")
    every = kept.select("feature_id", F.lit(0).alias("ring_no"), "refs", "layer", "terrain", "road_class", "width_m").unionByName(
        rings.select("feature_id", "ring_no", "refs", F.lit("area").alias("layer"), "terrain", F.lit(None).cast("int").alias("road_class"), F.lit(None).cast("double").alias("width_m")))
    every = every.withColumn("key", F.struct("feature_id", "ring_no", "layer", "terrain", "road_class", "width_m"))
    return with_envelope(resolve_points(every, points, "key", 2).select("key.*", "xs", "ys"))


def split_features(shapes: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Areas, buildings, roads and pois; the first three of resolved ``shapes``, all with xs, ys and their envelope."""
    areal = F.size("xs") >= 4
    pois = nodes.withColumn("kind", C.poi_kind(F.col("tags"))).filter(F.col("kind").isNotNull())
    x, y = mercator_x(F.col("lon")), mercator_y(F.col("lat"))
    return {
        "areas": shapes.filter((F.col("layer") == "area") & areal).select("feature_id", "ring_no", "terrain", "xs", "ys", *ENVELOPE),
        "buildings": shapes.filter((F.col("layer") == "building") & areal).select("feature_id", "xs", "ys", *ENVELOPE),
        "roads": shapes.filter(F.col("layer") == "road").select("feature_id", "road_class", "width_m", "xs", "ys", *ENVELOPE),
        "pois": pois.select(F.col("id").alias("feature_id"), "kind", C.poi_name(F.col("tags")).alias("name"), F.array(x).alias("xs"), F.array(y).alias("ys"), x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y")),
    }


def extract_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Areas, buildings, roads and pois in mercator metres, straight from the elements."""
    return split_features(resolve_shapes(nodes, ways, relations), nodes)


def bake_layers(features: dict[str, DataFrame], grid: Grid, lods: DataFrame, tiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Flat rows of each layer by tile and level, quantized; a feature with a point out of range is dropped."""
    left, bottom = grid.origin_of(F.col("tile_id"))
    drop = lambda rows: rows.withColumn("points", quantize_points(F.col("xs"), F.col("ys"), left, bottom)).filter(F.col("points").isNotNull()).withColumn("bounds", quantized_bounds(F.col("points")))
    areas = drop(assign_tiles(simplify_areas(features["areas"], lods), grid, tiles))
    buildings = drop(dissolve_dense(assign_tiles(simplify_buildings(features["buildings"], lods), grid, tiles)))
    roads = drop(assign_tiles(simplify_roads(features["roads"], lods), grid, tiles))
    pois = drop(assign_tiles(simplify_pois(features["pois"], lods), grid, tiles))
    return {
        "areas": areas.select("tile_id", "lod", F.col("terrain").alias("kind"), "bounds", F.array("points").alias("rings")),
        "buildings": buildings.select("tile_id", "lod", "bounds", F.col("points").alias("footprint")),
        "roads": roads.select("tile_id", "lod", F.col("road_class").alias("class"), "width_m", "bounds", "points"),
        "pois": pois.select("tile_id", "lod", "kind", "name", F.col("points")[0].alias("point")),
    }


def nested_tiles(layers: dict[str, DataFrame], keep: tuple[str, ...] = ("roads", "buildings", "areas", "pois")) -> DataFrame:
    """(tile_id, lods): one row per tile, levels in order, each with the arrays of its layers."""
    lists = None
    for name in keep:
        own = [c for c in layers[name].columns if c not in ("tile_id", "lod")]
        rows = layers[name].groupBy("tile_id", "lod").agg(F.collect_list(F.struct(*own)).alias(name))
        lists = rows if lists is None else lists.join(rows, ["tile_id", "lod"], "full")
    level = F.struct("lod", *(F.coalesce(n, F.array()).alias(n) for n in keep))
    return lists.groupBy("tile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lod", level.alias("level")))), lambda x: x["level"]).alias("lods"))


def build_index(spark: SparkSession, scan: Scan, region: str, source: str, tiles: DataFrame) -> DataFrame:
    """The one-row index document; its tiles are sorted by id."""
    g = scan.grid
    struct = lambda **kw: F.struct(*(F.lit(v).alias(k) for k, v in kw.items()))
    floats = lambda values: F.array(*(F.lit(float(v)).cast("float") for v in values))
    rows = tiles.agg(F.array_sort(F.collect_list(F.struct(*tiles.columns))).alias("tiles"))
    names = ("min_x", "min_y", "max_x", "max_y"), ("min_lat", "min_lon", "max_lat", "max_lon")
    return rows.select(
        F.lit(1).alias("version"), F.lit(region).alias("region"), F.lit(source).alias("source_pbf"), F.lit(scan.chunks).cast("bigint").alias("total_chunks_estimate"),
        F.lit(g.count).cast("bigint").alias("total_tile_count"), F.lit(len(scan.levels)).alias("lod_count"), floats(v.distance_m for v in scan.levels).alias("lod_viewing_distances_m"),
        floats(v.tolerance_m for v in scan.levels).alias("lod_simplification_tolerances_m"), F.lit(QUANTIZATION_SCALE).cast("float").alias("quantization_scale"),
        struct(origin_x_m=g.origin_x, origin_y_m=g.origin_y, tile_size_m=g.size, cols=g.cols, rows=g.rows).alias("tile_grid"),
        struct(**dict(zip(names[0], scan.mercator))).alias("world_bounds_mercator"), struct(**dict(zip(names[1], scan.lat_lon))).alias("world_bounds_lat_lon"), "tiles",
    )


def bake(
    elements: dict[str, DataFrame], root: str, region: str, *, source: str = "", tile_size: int = 100_000, tile_ids: list[int] | None = None,
    lat_lon_box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Bake the selected tiles (all by default) and rewrite the index; returns the index as read back.

    Selected tiles are baked anew, tiles of earlier runs stay. ``elements``: node, way and relation.
    """
    spark = elements["node"].sparkSession
    scan = scan_bounds(elements["node"], tile_size)
    tiles = selected_tiles(scan.grid, spark, tile_ids, lat_lon_box)
    before = T.index_rows(spark, root, region)
    before = None if before is None else spark.createDataFrame(before.collect(), before.schema)  # read before it is replaced; a row for each tile of the map
    # the four layers read the resolved shapes, not the elements again; part files by layer, so each reads its own
    folder = T.draft_path(root, region)
    try:
        resolve_shapes(elements["node"], elements["way"], elements["relation"]).write.partitionBy("layer").parquet(folder)
        shapes = spark.read.schema(SHAPES).parquet(folder)
        T.write_layers(bake_layers(split_features(shapes, elements["node"]), scan.grid, lod_table(spark, len(scan.levels)), tiles), root, region)
    finally:
        remove(spark, folder)
    entities = T.baked_entities(spark, root, region)
    stored = entities.select("tile_id").distinct().unionByName(tiles.select("tile_id")).distinct()
    on_disk = manifest_rows(entity_counts(entities, stored), scan.grid, T.tile_sizes(entities))
    specs = scan.grid.specs(spark)
    if before is None:
        rows = recover_manifest(specs, on_disk, on_disk.limit(0))
    else:
        # tiles that were not baked now keep the origin they were baked with
        kept = with_old_origin(on_disk.join(tiles.select(F.col("tile_id").alias("id")), "id", "left_anti"), before)
        rows = recover_manifest(specs, kept.unionByName(on_disk.join(tiles.select(F.col("tile_id").alias("id")), "id", "left_semi")), before)
    T.write_index(build_index(spark, scan, region, source, rows), root, region)
    return T.read_index(spark, root, region)
