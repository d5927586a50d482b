"""The registered queries over the derived map elements, each with its SQL for comparison where SQL can express it.

Doubles are compared as whole centimetres (or other whole units), since engines differ in the last bits of tan and ln.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.geometry import simplify_once, valid_ring_udf
from ..functions.grid import Grid, tile_ids_of_ranges
from ..functions.lod import Lod, lod_for_radius, lod_table, poi_visible, road_visible, road_width
from ..functions.project import box_area, box_diagonal, centimetres, mercator_x, mercator_y, quantize_points, quantized_bounds, snap, to_world, without_repeats
from ..operators import manifest, resolve, tiling
from ..operators.dissolve import dissolve_dense, with_bucket
from ..operators.simplify import at_levels, simplify_buildings
from ..schema import DENSE_BUILDINGS, LOD_DISTANCES_M, LOD_TOLERANCES_M, PLACES, ROAD_CLASS, ROAD_COLOR, ROAD_HIGHWAYS, ROAD_LAST_LOD, ROAD_WIDTH_M, TERRAIN, TERRAIN_COLOR, TERRAIN_PRIORITY, TERRAIN_TAGS
from ..sources import osm, tiles
from ..sources.store import put_file, shared_folder
from ..sources.views import LAT, LON, VIEWS, view, with_views
from ..streaming import viewport
from .bake import bake_layers, build_index, nested_tiles, scan_bounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GRID = Grid.from_lat_lon(LAT[0], LON[0], LAT[1], LON[1], 20_000)
BIG = Grid.from_lat_lon(LAT[0], LON[0], LAT[1], LON[1], 100_000)
N_LODS = 10
LEVELS = Lod.levels(N_LODS)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- pieces of SQL


def mx(lon: str) -> str:
    return f"(radians({lon}) * 6378137e0)"


def my(lat: str) -> str:
    return f"(ln(tan(0.7853981633974483e0 + radians(greatest(least({lat}, 85.05112878e0), -85.05112878e0)) / 2)) * 6378137e0)"


def cm(v: str) -> str:
    return f"CAST(floor(({v}) * 100 + 0.5e0) AS BIGINT)"


def away(v: str) -> str:
    return f"(sign({v}) * floor(abs({v}) + 0.5e0))"


def case(pairs: list[tuple[str, object]], end: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {end} END"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


TERRAIN_CASE = case([(f"k = '{key}'" + ("" if values == ["*"] else f" AND v IN ({quoted(values)})"), TERRAIN[t]) for t, keys in TERRAIN_TAGS.items() for key, values in keys.items()])
RANK_CASE = case([(f"code = {TERRAIN[t]}", r) for t, r in TERRAIN_PRIORITY.items()])
CLASS_CASE = case([(f"highway IN ({quoted(h)})", ROAD_CLASS[c]) for c, h in ROAD_HIGHWAYS.items()])
WIDTH_CASE = case([(f"highway IN ({quoted(h)})", int(ROAD_WIDTH_M[c] * 10)) for c, h in ROAD_HIGHWAYS.items()])
LAST_LOD_CASE = case([(f"road_class = {ROAD_CLASS[c]}", n) for c, n in ROAD_LAST_LOD.items() if n is not None], "99")
LOD_ROWS = "lods AS (SELECT * FROM (VALUES " + ", ".join(
    f"({v.lod}, {v.epsilon!r}::DOUBLE, {v.min_area_box!r}::DOUBLE, {v.min_building_box!r}::DOUBLE, {v.min_road_diagonal!r}::DOUBLE, {v.snap_m!r}::DOUBLE, {v.bucket_m!r}::DOUBLE, {v.dense or 'NULL'})" for v in LEVELS
) + ") t(lod, epsilon, min_area_box, min_building_box, min_road_diagonal, snap_m, bucket_m, dense))"


def envelopes(name: str, of: str) -> str:
    return f"{name} AS (SELECT way_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM (SELECT way_id, {mx('lon')} AS x, {my('lat')} AS y FROM {of}) GROUP BY way_id)"


def tile_rows(grid: Grid) -> str:
    return f"tiles AS (SELECT CAST(t AS BIGINT) AS tile_id, {grid.origin_x!r} + (t % {grid.cols}) * {grid.size} AS x0, {grid.origin_y!r} + (t // {grid.cols}) * {grid.size} AS y0 FROM range({grid.count}) r(t))"


def meets(grid: Grid, e: str = "e") -> str:
    return f"{e}.min_x <= t.x0 + {grid.size * 1.01!r} AND {e}.max_x >= t.x0 - {grid.size * 0.01!r} AND {e}.min_y <= t.y0 + {grid.size * 1.01!r} AND {e}.max_y >= t.y0 - {grid.size * 0.01!r}"


def assigned_sql(view_name: str) -> str:
    return with_views(view_name, more=", ".join([envelopes("env", view_name), tile_rows(GRID)])) + f" SELECT t.tile_id, e.way_id FROM env e JOIN tiles t ON {meets(GRID)}"


# ---------------------------------------------------------------- pieces of Spark


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name).select("way_id", "pos", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"))


def boxes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return points(spark, sf_dir, name).groupBy("way_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def poi_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = mercator_x(F.col("lon")), mercator_y(F.col("lat"))
    return view(spark, sf_dir, "poi").select(F.col("node_id").alias("way_id"), x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y"))


def classed_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.coalesce(F.col("area") == "yes", F.lit(False))
    roads = view(spark, sf_dir, "road").select("way_id", C.road_class_of(F.col("highway"), area).alias("road_class"), C.road_width_of(F.col("highway"), area).alias("width_m"))
    return roads.filter(F.col("road_class").isNotNull())


def tags(*pairs: tuple[str | Column, Column]) -> Column:
    """Array of the tags whose value is not null."""
    made = F.array(*(F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v")) for k, v in pairs))
    return F.filter(made, lambda t: t["v"].isNotNull())


def box(f) -> Column:
    return f(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "camera").select("user_id", "event_id", "ts", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"), "scale")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- projection, grid, levels


@query(with_views("road_pt") + f" SELECT way_id, pos, {cm(mx('lon'))} AS x_cm, {cm(my('lat'))} AS y_cm FROM road_pt")
def mercator_project(spark, sf_dir):
    return points(spark, sf_dir, "road_pt").select("way_id", "pos", centimetres(F.col("x")).alias("x_cm"), centimetres(F.col("y")).alias("y_cm"))


_ALL_POINTS = "pts AS (" + " UNION ALL ".join(f"SELECT lat, lon FROM {v}" for v in ("road_pt", "bld_pt", "area_pt", "poi")) + ")"


@query(with_views("road_pt", "bld_pt", "area_pt", "poi", more=_ALL_POINTS) + f"""
SELECT CAST(floor(min(lat) * 1e7 + 0.5e0) AS BIGINT) AS min_lat_e7, CAST(floor(max(lat) * 1e7 + 0.5e0) AS BIGINT) AS max_lat_e7, CAST(floor(min(lon) * 1e7 + 0.5e0) AS BIGINT) AS min_lon_e7,
  CAST(floor(max(lon) * 1e7 + 0.5e0) AS BIGINT) AS max_lon_e7, {cm(f"min({mx('lon')})")} AS min_x_cm, {cm(f"max({mx('lon')})")} AS max_x_cm, {cm(f"min({my('lat')})")} AS min_y_cm, {cm(f"max({my('lat')})")} AS max_y_cm,
  CAST(floor((max({mx('lon')}) - min({mx('lon')})) * (max({my('lat')}) - min({my('lat')})) / 1e6 + 0.5e0) AS BIGINT) AS area_km2 FROM pts""")
def bounds_scan(spark, sf_dir):
    every = None
    for name in ("road_pt", "bld_pt", "area_pt", "poi"):
        part = view(spark, sf_dir, name).select("lat", "lon")
        every = part if every is None else every.unionByName(part)
    x, y, e7 = mercator_x(F.col("lon")), mercator_y(F.col("lat")), lambda c: F.floor(c * 1e7 + 0.5).cast("bigint")
    return every.agg(
        e7(F.min("lat")).alias("min_lat_e7"), e7(F.max("lat")).alias("max_lat_e7"), e7(F.min("lon")).alias("min_lon_e7"), e7(F.max("lon")).alias("max_lon_e7"),
        centimetres(F.min(x)).alias("min_x_cm"), centimetres(F.max(x)).alias("max_x_cm"), centimetres(F.min(y)).alias("min_y_cm"), centimetres(F.max(y)).alias("max_y_cm"),
        F.floor(box_area(F.min(x), F.min(y), F.max(x), F.max(y)) / 1e6 + 0.5).cast("bigint").alias("area_km2"),
    )


@query(f"""WITH b AS (SELECT {mx('88e0')} AS x0, {my('20.5e0')} AS y0, {mx('92.5e0')} AS x1, {my('26.5e0')} AS y1),
g AS (SELECT floor(x0 / 100000) * 100000 AS ox, floor(y0 / 100000) * 100000 AS oy, x1, y1 FROM b),
n AS (SELECT *, CAST(greatest(ceil((x1 - ox) / 100000), 1) AS BIGINT) AS cols, CAST(greatest(ceil((y1 - oy) / 100000), 1) AS BIGINT) AS tile_rows FROM g)
SELECT r * cols + c AS tile_id, c AS grid_x, r AS grid_y, CAST(ox + c * 100000 AS BIGINT) AS min_x, CAST(oy + r * 100000 AS BIGINT) AS min_y, CAST(ox + (c + 1) * 100000 AS BIGINT) AS max_x, CAST(oy + (r + 1) * 100000 AS BIGINT) AS max_y
FROM n, range(1000) a(c), range(1000) d(r) WHERE c < cols AND r < tile_rows""")
def tile_grid(spark, sf_dir):
    return BIG.specs(spark).select("tile_id", "grid_x", "grid_y", *(F.col(c).cast("bigint").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


_SEVEN = lambda values: "[" + ", ".join(map(repr, values)) + "]"


@query(f"""WITH b AS (SELECT {mx('88e0')} AS x0, {my('20.5e0')} AS y0, {mx('92.5e0')} AS x1, {my('26.5e0')} AS y1),
n AS (SELECT greatest(CAST(ceil(log2(ceil(greatest((x1 - x0) * (y1 - y0) / 1e6, 1)) / 1000)) AS INT) + 1, 2) AS n FROM b),
l AS (SELECT CAST(i AS INT) AS lod, CAST({_SEVEN(LOD_DISTANCES_M)}[least(i, 6) + 1] AS FLOAT) AS d, CAST({_SEVEN(LOD_TOLERANCES_M)}[least(i, 6) + 1] AS FLOAT) AS t FROM n, range(100) r(i) WHERE i < n.n)
SELECT lod, CAST(d AS BIGINT) AS distance_m, CAST(round(t * 1000) AS BIGINT) AS tolerance_mm, CAST(floor(CAST(t * t AS DOUBLE) * 1e6 + 0.5e0) AS BIGINT) AS epsilon_e6,
  CAST(CASE WHEN lod = 0 THEN 0 ELSE greatest(t, 1) * greatest(t, 1) * 4 END AS BIGINT) AS min_area_box, CAST(CASE WHEN lod = 0 THEN 8 ELSE greatest(t, 1) * greatest(t, 1) * 6 END AS BIGINT) AS min_building_box,
  CAST(round(CASE WHEN lod = 0 THEN 0 ELSE t * 2000 END) AS BIGINT) AS min_road_diagonal_mm, CAST(CASE WHEN lod < 2 THEN 0 ELSE least(greatest(t, 1), 32) END AS BIGINT) AS snap_m,
  CAST(least(greatest(greatest(CASE WHEN lod < 2 THEN 0 ELSE least(greatest(t, 1), 32) END, 1) * 12, 32), 128) AS BIGINT) AS bucket_m,
  CASE WHEN lod = 2 THEN 12 WHEN lod = 3 THEN 10 WHEN lod = 4 THEN 8 WHEN lod = 5 THEN 6 WHEN lod > 5 THEN 4 END AS dense FROM l""")
def lod_settings(spark, sf_dir):
    whole = lambda c, k=1: F.floor(F.col(c) * k + 0.5).cast("bigint")
    return lod_table(spark, N_LODS).select(
        "lod", whole("distance_m").alias("distance_m"), whole("tolerance_m", 1000).alias("tolerance_mm"), whole("epsilon", 1_000_000).alias("epsilon_e6"), whole("min_area_box").alias("min_area_box"),
        whole("min_building_box").alias("min_building_box"), whole("min_road_diagonal", 1000).alias("min_road_diagonal_mm"), whole("snap_m").alias("snap_m"), whole("bucket_m").alias("bucket_m"), "dense",
    )


_COL = lambda x, g: f"CAST(floor(({x} - {g.origin_x!r}) / {g.size}) AS BIGINT)"
_ROW = lambda y, g: f"CAST(floor(({y} - {g.origin_y!r}) / {g.size}) AS BIGINT)"


@query(with_views("poi", more=f"""q AS (SELECT node_id, {mx('lon')} AS xa, {my('lat')} AS ya, {mx('lon - 0.3e0 + (node_id % 7) * 0.1e0')} AS xb, {my('lat + (node_id % 5) * 0.1e0')} AS yb FROM poi),
r AS (SELECT node_id, greatest(least({_COL('least(xa, xb)', GRID)}, {GRID.cols - 1}), 0) AS c0, greatest(least({_COL('greatest(xa, xb)', GRID)}, {GRID.cols - 1}), 0) AS c1,
  greatest(least({_ROW('least(ya, yb)', GRID)}, {GRID.rows - 1}), 0) AS r0, greatest(least({_ROW('greatest(ya, yb)', GRID)}, {GRID.rows - 1}), 0) AS r1 FROM q)""") + f"""
SELECT node_id, y * {GRID.cols} + x AS tile_id FROM (SELECT node_id, c0, c1, unnest(range(r0, r1 + 1)) AS y FROM r), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS x)""")
def tiles_for_bounds(spark, sf_dir):
    rows = view(spark, sf_dir, "poi")
    ids = GRID.ids_for_lat_lon_box(F.col("lat"), F.col("lon"), F.col("lat") + (F.col("node_id") % 5) * 0.1, F.col("lon") - 0.3 + (F.col("node_id") % 7) * 0.1)
    return rows.select("node_id", F.explode(ids).alias("tile_id"))


@query("""SELECT DISTINCT s_suppkey, unnest(CASE WHEN p LIKE '%-%' THEN range(CAST(trim(split_part(p, '-', 1)) AS BIGINT), CAST(trim(split_part(p, '-', 2)) AS BIGINT) + 1) ELSE [CAST(trim(p) AS BIGINT)] END) AS tile_id
FROM (SELECT s_suppkey, unnest(string_split(concat(s_suppkey % 40, ', ', s_suppkey % 30, '-', s_suppkey % 30 + s_suppkey % 5, ',,', s_suppkey % 7), ',')) AS p FROM supplier) WHERE trim(p) <> ''""")
def tile_id_ranges(spark, sf_dir):
    key = F.col("s_suppkey")
    text = F.concat_ws("", key % 40, F.lit(", "), key % 30, F.lit("-"), key % 30 + key % 5, F.lit(",,"), key % 7)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(tile_ids_of_ranges(text, BIG.count - 1)).alias("tile_id"))


# ---------------------------------------------------------------- classification


@query(with_views("area_tag") + f" SELECT way_id, tag_no, k, v, {TERRAIN_CASE} AS terrain FROM area_tag")
def terrain_classify(spark, sf_dir):
    return view(spark, sf_dir, "area_tag").select("way_id", "tag_no", "k", "v", C.terrain_of(F.col("k"), F.col("v")).alias("terrain"))


_BEST = f"best AS (SELECT way_id, arg_max(code, rank) AS terrain FROM (SELECT *, {RANK_CASE} AS rank FROM (SELECT way_id, {TERRAIN_CASE} AS code FROM area_tag)) GROUP BY way_id)"


def tagged_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "area_tag").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("tag_no", "k", "v"))).alias("t"))
    return rows.select("way_id", F.transform("t", lambda t: F.struct(t["k"].alias("k"), t["v"].alias("v"))).alias("tags"))


@query(with_views("area_tag", more=_BEST) + " SELECT way_id, terrain FROM best")
def terrain_best(spark, sf_dir):
    return tagged_areas(spark, sf_dir).select("way_id", C.best_terrain(F.col("tags")).alias("terrain"))


@query(with_views("road") + f" SELECT way_id, CASE WHEN area IS NULL THEN {CLASS_CASE} END AS road_class, CASE WHEN area IS NULL THEN {WIDTH_CASE} END AS width_dm FROM road")
def road_classify(spark, sf_dir):
    area = F.coalesce(F.col("area") == "yes", F.lit(False))
    return view(spark, sf_dir, "road").select("way_id", C.road_class_of(F.col("highway"), area).alias("road_class"), (C.road_width_of(F.col("highway"), area) * 10).cast("int").alias("width_dm"))


@query(with_views("road", more=f"w AS (SELECT way_id, way_id % 13 = 0 AS building, CASE WHEN area IS NULL THEN {CLASS_CASE} END AS rc, CASE WHEN way_id % 7 = 0 THEN 1 WHEN way_id % 5 = 0 THEN 3 END AS tc FROM road)") + """
SELECT way_id, CASE WHEN building THEN 'building' WHEN rc IS NOT NULL THEN 'road' WHEN tc IS NOT NULL THEN 'area' ELSE 'none' END AS layer,
  CASE WHEN NOT building AND rc IS NULL THEN tc END AS terrain, CASE WHEN NOT building THEN rc END AS road_class FROM w""")
def way_classify(spark, sf_dir):
    key, some = F.col("way_id"), lambda test, v: F.when(test, v)
    made = tags(("highway", F.col("highway")), ("area", F.col("area")), ("building", some(key % 13 == 0, "no")), ("natural", some(key % 7 == 0, "water")), ("landuse", some(key % 5 == 0, "forest")))
    kind = view(spark, sf_dir, "road").select("way_id", C.way_kind(made).alias("kind"))
    return kind.select("way_id", F.coalesce("kind.layer", F.lit("none")).alias("layer"), "kind.terrain", "kind.road_class")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = view(spark, sf_dir, "rel_member").groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("mtype").alias("type"), F.col("member_id").alias("ref"), "role"))).alias("m"))
    key = F.col("rel_id") - 400000000
    made = tags(("type", F.when(key % 3 != 0, "multipolygon").otherwise("route")), ("natural", F.when(key % 2 == 0, "water")), ("landuse", F.when(key % 2 == 1, "forest")), ("building", F.when(key % 7 == 0, "yes")))
    return members.select(F.col("rel_id").alias("id"), F.transform("m", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"))).alias("members"), made.alias("tags"))


def relation_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = view(spark, sf_dir, "rel_way_ref").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("r"))
    return refs.select(F.col("way_id").alias("id"), F.transform("r", lambda r: r["node_id"]).alias("refs"))


_REL_TERRAIN = "CASE WHEN (rel_id - 400000000) % 3 <> 0 THEN CASE WHEN (rel_id - 400000000) % 2 = 0 THEN 1 WHEN (rel_id - 400000000) % 7 = 0 THEN 4 ELSE 3 END END"


@query(with_views("rel_member") + f" SELECT rel_id, CAST(count(*) FILTER (WHERE mtype = 'way' AND role IN ('outer', '')) AS INT) AS n_outer, {_REL_TERRAIN} AS terrain FROM rel_member GROUP BY rel_id")
def relation_classify(spark, sf_dir):
    outer = F.size(C.outer_members(F.col("members")))
    return relations(spark, sf_dir).filter(outer > 0).select(F.col("id").alias("rel_id"), outer.alias("n_outer"), C.relation_terrain(F.col("tags")).alias("terrain"))


@query(with_views("poi") + f" SELECT node_id, concat(k, ':', v) AS kind, name FROM poi WHERE k IN ('amenity', 'tourism') OR (k = 'railway' AND v = 'station') OR (k = 'aeroway' AND v = 'aerodrome') OR (k = 'place' AND v IN ({quoted(PLACES)}))")
def poi_classify(spark, sf_dir):
    made = tags(("name", F.col("name")), (F.col("k"), F.col("v")))
    return view(spark, sf_dir, "poi").select("node_id", C.poi_kind(made).alias("kind"), C.poi_name(made).alias("name")).filter(F.col("kind").isNotNull())


# ---------------------------------------------------------------- joins to geometry


@query(with_views("road_pt", more="w AS (SELECT way_id, count(*) AS n, arg_min(node_id % 5, pos) AS a, arg_max(node_id % 5, pos) AS b FROM road_pt GROUP BY way_id)") + " SELECT way_id, n >= 4 AND a = b AS closed, n >= 2 AS open FROM w")
def closed_way_filter(spark, sf_dir):
    ways = view(spark, sf_dir, "road_pt").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("node_id") % 5).alias("ref")))).alias("r"))
    refs = F.transform("r", lambda r: r["ref"])
    return ways.select("way_id", C.is_closed_way(refs).alias("closed"), C.is_open_way(refs).alias("open"))


@query(with_views("rel_member", "rel_way_ref") + " SELECT m.rel_id, m.pos AS member_pos, r.pos AS ref_pos, r.node_id FROM rel_member m JOIN rel_way_ref r ON m.member_id = r.way_id WHERE m.mtype = 'way' AND m.role IN ('outer', '')")
def relation_members(spark, sf_dir):
    found = resolve.member_segments(relations(spark, sf_dir), relation_ways(spark, sf_dir))
    rows = found.select("rel_id", F.explode(F.arrays_zip("segments", "places")).alias("s"))
    rows = rows.select("rel_id", (F.col("s.places") + 1).cast("bigint").alias("member_pos"), F.posexplode("s.segments").alias("j", "node_id"))
    return rows.select("rel_id", "member_pos", (F.col("j") + 1).cast("bigint").alias("ref_pos"), "node_id")


@query("SELECT s_suppkey + 400000000 AS rel_id, CAST(0 AS INT) AS ring_no, CAST(p.i AS INT) AS pos, s_suppkey * 10 + [5, 6, 1, 2, 3, 4, 5][p.i + 1] AS node_id FROM supplier, range(7) p(i) WHERE s_suppkey % 5 <> 0")
def ring_stitch(spark, sf_dir):
    rings = resolve.stitched_rings(resolve.member_segments(relations(spark, sf_dir), relation_ways(spark, sf_dir)))
    return rings.select("rel_id", "ring_no", F.posexplode("refs").alias("pos", "node_id"))


@query(with_views("road_pt", more="f AS (SELECT r.way_id FROM road_pt r LEFT JOIN part p ON p.p_partkey = r.node_id AND p.p_partkey % 50 <> 0 GROUP BY r.way_id HAVING count(p.p_partkey) = count(*) AND count(*) >= 2)") + """
SELECT r.way_id, CAST(r.pos - 1 AS INT) AS pos, CAST(r.node_id * 3 AS BIGINT) AS x2, CAST(r.node_id % 97 AS BIGINT) AS y FROM road_pt r JOIN f ON f.way_id = r.way_id""")
def resolve_points(spark, sf_dir):
    ways = view(spark, sf_dir, "road_pt").groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda r: r["node_id"]).alias("refs"))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").filter(F.col("p_partkey") % 50 != 0).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 1.5).alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    found = resolve.resolve_points(ways, nodes, "way_id", 2)
    rows = found.select("way_id", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p"))
    return rows.select("way_id", "pos", (F.col("p.xs") * 2).cast("bigint").alias("x2"), F.col("p.ys").cast("bigint").alias("y"))


@query(with_views("area_tag", "rel_member", more=_BEST) + f" SELECT 'way' AS origin, way_id AS id, terrain FROM best WHERE terrain IS NOT NULL UNION ALL SELECT 'relation', rel_id, {_REL_TERRAIN} FROM rel_member WHERE {_REL_TERRAIN} IS NOT NULL GROUP BY rel_id")
def area_union_all(spark, sf_dir):
    ways = tagged_areas(spark, sf_dir).select(F.lit("way").alias("origin"), F.col("way_id").alias("id"), C.best_terrain(F.col("tags")).alias("terrain"))
    rels = relations(spark, sf_dir).select(F.lit("relation").alias("origin"), "id", C.relation_terrain(F.col("tags")).alias("terrain"))
    return ways.unionByName(rels).filter(F.col("terrain").isNotNull())


@query(with_views("road_pt", more=envelopes("env", "road_pt")) + " SELECT way_id, " + ", ".join(f"{cm(c)} AS {c}_cm" for c in ("min_x", "min_y", "max_x", "max_y")) + " FROM env")
def feature_envelope(spark, sf_dir):
    shapes = resolve.with_envelope(resolve.point_arrays(points(spark, sf_dir, "road_pt"), "way_id"))
    return shapes.select("way_id", *(centimetres(F.col(c)).alias(f"{c}_cm") for c in ("min_x", "min_y", "max_x", "max_y")))


# ---------------------------------------------------------------- tiles


@query(assigned_sql("area_pt"))
def tile_assign_area(spark, sf_dir):
    return tiling.assign_tiles(boxes(spark, sf_dir, "area_pt"), GRID).select("tile_id", "way_id")


@query(assigned_sql("bld_pt"))
def tile_assign_building(spark, sf_dir):
    return tiling.assign_tiles(boxes(spark, sf_dir, "bld_pt"), GRID).select("tile_id", "way_id")


@query(assigned_sql("road_pt"))
def tile_assign_road(spark, sf_dir):
    return tiling.assign_tiles(boxes(spark, sf_dir, "road_pt"), GRID).select("tile_id", "way_id")


_POI_ENV = f"env AS (SELECT node_id AS way_id, {mx('lon')} AS min_x, {my('lat')} AS min_y, {mx('lon')} AS max_x, {my('lat')} AS max_y FROM poi)"


@query(with_views("poi", more=", ".join([_POI_ENV, tile_rows(GRID)])) + f" SELECT t.tile_id, e.way_id FROM env e JOIN tiles t ON {meets(GRID)}")
def tile_assign_poi(spark, sf_dir):
    return tiling.assign_tiles(poi_boxes(spark, sf_dir), GRID).select("tile_id", "way_id")


@query(with_views("road_pt", "road", more=", ".join([envelopes("env", "road_pt"), tile_rows(GRID), f"cls AS (SELECT way_id, {CLASS_CASE} AS road_class FROM road WHERE area IS NULL)"])) + f"""
SELECT t.tile_id, c.road_class, count(*) AS n FROM env e JOIN cls c ON c.way_id = e.way_id JOIN tiles t ON {meets(GRID)} WHERE c.road_class IS NOT NULL GROUP BY t.tile_id, c.road_class""")
def tile_road_counts(spark, sf_dir):
    roads = boxes(spark, sf_dir, "road_pt").join(classed_roads(spark, sf_dir), "way_id")
    return tiling.assign_tiles(roads, GRID).groupBy("tile_id", "road_class").agg(F.count(F.lit(1)).alias("n"))


_BOX = (21.2, 89.1, 22.9, 90.4)


@query(f"""WITH t AS (SELECT CAST(t AS BIGINT) AS tile_id FROM range({GRID.count}) r(t)),
b AS (SELECT {_COL(mx(f'{_BOX[1]}e0'), GRID)} AS c0, {_ROW(my(f'{_BOX[0]}e0'), GRID)} AS r0, {_COL(mx(f'{_BOX[3]}e0'), GRID)} AS c1, {_ROW(my(f'{_BOX[2]}e0'), GRID)} AS r1)
SELECT 'ids' AS chosen_by, tile_id FROM t WHERE tile_id IN (3, 4, 5, 17) UNION ALL SELECT 'box', tile_id FROM t, b WHERE tile_id % {GRID.cols} BETWEEN c0 AND c1 AND tile_id // {GRID.cols} BETWEEN r0 AND r1
UNION ALL SELECT 'all', tile_id FROM t""")
def tile_selection(spark, sf_dir):
    """Ids go before a box, a box before everything; unknown ids choose nothing."""
    chosen = {"ids": {"tile_ids": [5, 3, 4, 17, 3, GRID.count + 7], "lat_lon_box": _BOX}, "box": {"lat_lon_box": _BOX}, "all": {}}
    out = None
    for name, how in chosen.items():
        rows = tiling.selected_tiles(GRID, spark, **how).select(F.lit(name).alias("chosen_by"), "tile_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- levels


_CLASSED = f"cls AS (SELECT way_id, {CLASS_CASE} AS road_class FROM road WHERE area IS NULL)"


@query(with_views("road", more=", ".join([_CLASSED, LOD_ROWS])) + f" SELECT way_id, lod FROM cls, lods WHERE road_class IS NOT NULL AND lod <= {LAST_LOD_CASE}")
def road_visible_lod(spark, sf_dir):
    return at_levels(classed_roads(spark, sf_dir), lod_table(spark, N_LODS)).filter(road_visible(F.col("road_class"), F.col("lod"))).select("way_id", "lod")


@query(with_views("road", more=", ".join([f"cls AS (SELECT DISTINCT {CLASS_CASE} AS road_class, {WIDTH_CASE} AS w FROM road WHERE area IS NULL)", LOD_ROWS])) + f"""
SELECT road_class, lod, CAST(floor(CAST(greatest(CAST(CAST(w / 10e0 AS FLOAT) / CAST(CAST(1 AS FLOAT) + CAST(CAST(lod AS FLOAT) * CAST(0.12 AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT), CAST(1 AS FLOAT)) AS DOUBLE) * 1000 + 0.5e0) AS BIGINT) AS width_mm
FROM cls, lods WHERE road_class IS NOT NULL""")
def road_width_lod(spark, sf_dir):
    classes = classed_roads(spark, sf_dir).select("road_class", "width_m").distinct()
    return at_levels(classes, lod_table(spark, N_LODS)).select("road_class", "lod", F.floor(road_width(F.col("width_m"), F.col("lod")).cast("double") * 1000 + 0.5).cast("bigint").alias("width_mm"))


@query(with_views("road_pt", more=", ".join([envelopes("env", "road_pt"), LOD_ROWS])) + " SELECT way_id, lod FROM env, lods WHERE lod = 0 OR sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y)) >= min_road_diagonal")
def road_length_filter(spark, sf_dir):
    return at_levels(boxes(spark, sf_dir, "road_pt"), lod_table(spark, N_LODS)).filter((F.col("lod") == 0) | (box(box_diagonal) >= F.col("min_road_diagonal"))).select("way_id", "lod")


@query(with_views("poi", more=", ".join([f"p AS (SELECT node_id, concat(k, ':', v) AS kind FROM poi WHERE k IN ('amenity', 'tourism') OR (k = 'railway' AND v = 'station') OR (k = 'place' AND v IN ({quoted(PLACES)})))", LOD_ROWS])) + """
SELECT node_id, lod, kind FROM p, lods WHERE lod < 4 OR kind LIKE 'place:%' OR kind = 'railway:station'""")
def poi_lod(spark, sf_dir):
    return at_levels(poi_classify(spark, sf_dir), lod_table(spark, N_LODS)).filter(poi_visible(F.col("kind"), F.col("lod"))).select("node_id", "lod", "kind")


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.assign_tiles(resolve.with_envelope(resolve.point_arrays(points(spark, sf_dir, "road_pt"), "way_id")), GRID)
    left, bottom = GRID.origin_of(F.col("tile_id"))
    rows = rows.withColumn("q", quantize_points(F.col("xs"), F.col("ys"), left, bottom)).filter(F.col("q").isNotNull())
    return rows.select("tile_id", "way_id", F.posexplode("q").alias("pos", "p")).select("tile_id", "way_id", "pos", F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))


_QUANTIZED = with_views("road_pt", more=", ".join([
    envelopes("env", "road_pt"), tile_rows(GRID), f"pt AS (SELECT way_id, CAST(pos - 1 AS INT) AS pos, {mx('lon')} AS x, {my('lat')} AS y FROM road_pt)",
    f"q AS (SELECT t.tile_id, t.x0, t.y0, p.way_id, p.pos, CAST({away('(p.x - t.x0) * 100')} AS INT) AS qx, CAST({away('(p.y - t.y0) * 100')} AS INT) AS qy FROM env e JOIN tiles t ON {meets(GRID)} JOIN pt p ON p.way_id = e.way_id)"]))


@query(_QUANTIZED + " SELECT tile_id, way_id, pos, qx, qy FROM q")
def quantize_roads(spark, sf_dir):
    return quantized(spark, sf_dir)


@query(_QUANTIZED + " SELECT tile_id, way_id, min(qx) AS min_x, min(qy) AS min_y, max(qx) AS max_x, max(qy) AS max_y FROM q GROUP BY tile_id, way_id")
def quantized_box(spark, sf_dir):
    rows = tiling.assign_tiles(resolve.with_envelope(resolve.point_arrays(points(spark, sf_dir, "road_pt"), "way_id")).select("way_id", "xs", "ys", "min_x", "min_y", "max_x", "max_y"), GRID)
    left, bottom = GRID.origin_of(F.col("tile_id"))
    return rows.select("tile_id", "way_id", quantized_bounds(quantize_points(F.col("xs"), F.col("ys"), left, bottom)).alias("b")).filter("b is not null").select("tile_id", "way_id", "b.*")


@query(_QUANTIZED + " SELECT tile_id, way_id, pos, CAST(CAST(x0 + qx / 100e0 AS FLOAT) * 4 AS BIGINT) AS x4, CAST(CAST(y0 + qy / 100e0 AS FLOAT) * 4 AS BIGINT) AS y4 FROM q")
def dequantize(spark, sf_dir):
    left, bottom = GRID.origin_of(F.col("tile_id"))
    return quantized(spark, sf_dir).select("tile_id", "way_id", "pos", (to_world(F.col("qx"), left) * 4).cast("bigint").alias("x4"), (to_world(F.col("qy"), bottom) * 4).cast("bigint").alias("y4"))


@query(with_views("road_pt", more=f"""s AS (SELECT way_id, pos, CAST({away(mx('lon') + ' / 900')} AS BIGINT) AS gx, CAST({away(my('lat') + ' / 900')} AS BIGINT) AS gy FROM road_pt),
l AS (SELECT *, lag(gx) OVER w AS px, lag(gy) OVER w AS py FROM s WINDOW w AS (PARTITION BY way_id ORDER BY pos))""") + """
SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS INT) AS pos, gx, gy FROM l WHERE px IS NULL OR px <> gx OR py <> gy""")
def dedup_points(spark, sf_dir):
    grid = lambda c: (snap(F.col(c), F.lit(900.0)) / 900).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct("pos", grid("x").alias("gx"), grid("y").alias("gy"))))
    rows = points(spark, sf_dir, "road_pt").groupBy("way_id").agg(F.transform(ordered, lambda p: F.struct(p["gx"].alias("gx"), p["gy"].alias("gy"))).alias("p"))
    return rows.select("way_id", F.posexplode(without_repeats(F.col("p"))).alias("pos", "q")).select("way_id", "pos", "q.gx", "q.gy")


@query(with_views("bld_pt", more=LOD_ROWS) + f" SELECT way_id, pos, lod, CAST({away(mx('lon') + ' / snap_m')} * snap_m AS BIGINT) AS gx, CAST({away(my('lat') + ' / snap_m')} * snap_m AS BIGINT) AS gy FROM bld_pt, lods WHERE lod BETWEEN 2 AND 5")
def snap_grid(spark, sf_dir):
    rows = at_levels(points(spark, sf_dir, "bld_pt"), lod_table(spark, N_LODS).filter(F.col("lod").between(2, 5)))
    return rows.select("way_id", "pos", "lod", snap(F.col("x"), F.col("snap_m")).cast("bigint").alias("gx"), snap(F.col("y"), F.col("snap_m")).cast("bigint").alias("gy"))


@query(with_views("bld_pt", more=", ".join([envelopes("env", "bld_pt"), LOD_ROWS])) + " SELECT way_id, lod FROM env, lods WHERE (max_x - min_x) * (max_y - min_y) >= min_building_box")
def building_min_area(spark, sf_dir):
    return at_levels(boxes(spark, sf_dir, "bld_pt"), lod_table(spark, N_LODS)).filter(box(box_area) >= F.col("min_building_box")).select("way_id", "lod")


@query(with_views("area_pt", more=", ".join([envelopes("env", "area_pt"), LOD_ROWS])) + " SELECT way_id, lod FROM env, lods WHERE lod = 0 OR (max_x - min_x) * (max_y - min_y) >= min_area_box")
def area_min_bbox(spark, sf_dir):
    return at_levels(boxes(spark, sf_dir, "area_pt"), lod_table(spark, N_LODS)).filter((F.col("lod") == 0) | (box(box_area) >= F.col("min_area_box"))).select("way_id", "lod")


@query(with_views("bld_pt", more=", ".join([envelopes("env", "bld_pt"), tile_rows(GRID), LOD_ROWS])) + f"""
SELECT t.tile_id, lod, CAST(floor((e.min_x + e.max_x) * 0.5e0 / bucket_m) AS BIGINT) AS bucket_x, CAST(floor((e.min_y + e.max_y) * 0.5e0 / bucket_m) AS BIGINT) AS bucket_y, count(*) AS n, count(*) >= any_value(dense) AS is_dense
FROM env e JOIN tiles t ON {meets(GRID)}, lods WHERE lod BETWEEN 2 AND 6 AND (e.max_x - e.min_x) * (e.max_y - e.min_y) >= min_building_box GROUP BY 1, 2, 3, 4""")
def building_density_bucket(spark, sf_dir):
    rows = at_levels(boxes(spark, sf_dir, "bld_pt"), lod_table(spark, N_LODS).filter(F.col("lod").between(2, 6))).filter(box(box_area) >= F.col("min_building_box"))
    rows = rows.withColumns({"box_x0": F.col("min_x"), "box_y0": F.col("min_y"), "box_x1": F.col("max_x"), "box_y1": F.col("max_y")})
    counted = with_bucket(tiling.assign_tiles(rows, GRID))
    return counted.select("tile_id", "lod", "bucket_x", "bucket_y", F.col("bucket_n").alias("n"), (F.col("bucket_n") >= F.col("dense")).alias("is_dense")).distinct()


@query()
def building_dissolve(spark, sf_dir):
    shapes = resolve.with_envelope(resolve.point_arrays(points(spark, sf_dir, "bld_pt"), "way_id"))
    rows = tiling.assign_tiles(simplify_buildings(shapes, lod_table(spark, 5)), GRID)
    return dissolve_dense(rows).groupBy("tile_id", "lod").agg(F.count(F.lit(1)).alias("n_buildings"), F.sum(F.size("xs")).alias("n_points"))


@query()
def simplify_vw(spark, sf_dir):
    rows = at_levels(resolve.point_arrays(points(spark, sf_dir, "road_pt"), "way_id"), lod_table(spark, 7))
    shape = simplify_once("xs", "ys", F.lit("road"), "lod", "epsilon", "snap_m")
    return rows.withColumn("s", shape).filter(F.col("s.xs").isNotNull()).select("way_id", "lod", F.size("xs").alias("n_before"), F.size("s.xs").alias("n_after"))


@query(with_views("bld_pt") + " SELECT DISTINCT way_id, way_id % 3 <> 0 AS valid FROM bld_pt")
def ring_validity(spark, sf_dir):
    # every third ring has its second and third corner swapped, and crosses itself
    pos = F.when((F.col("way_id") % 3 == 0) & F.col("pos").isin(2, 3), 5 - F.col("pos")).otherwise(F.col("pos"))
    shapes = resolve.point_arrays(points(spark, sf_dir, "bld_pt").withColumn("pos", pos), "way_id")
    return shapes.select("way_id", valid_ring_udf("xs", "ys").alias("valid"))


# ---------------------------------------------------------------- counts, manifest, nesting


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for layer, rows in (("roads", boxes(spark, sf_dir, "road_pt")), ("buildings", boxes(spark, sf_dir, "bld_pt")), ("areas", boxes(spark, sf_dir, "area_pt")), ("pois", poi_boxes(spark, sf_dir))):
        part = tiling.assign_tiles(rows, BIG).select("tile_id", F.lit(0).alias("lod"), F.lit(layer).alias("layer"))
        out = part if out is None else out.unionByName(part)
    return out


_ENTITIES = with_views("road_pt", "bld_pt", "area_pt", "poi", more=", ".join([
    envelopes("e_roads", "road_pt"), envelopes("e_buildings", "bld_pt"), envelopes("e_areas", "area_pt"), _POI_ENV.replace("env AS", "e_pois AS"), tile_rows(BIG),
    "hits AS (" + " UNION ALL ".join(f"SELECT t.tile_id, '{n}' AS layer FROM e_{n} e JOIN tiles t ON {meets(BIG)}" for n in manifest.LAYERS) + ")",
    "counts AS (SELECT t.tile_id, " + ", ".join(f"count(*) FILTER (WHERE layer = '{n}') AS {n}" for n in manifest.LAYERS) + " FROM tiles t LEFT JOIN hits h ON h.tile_id = t.tile_id GROUP BY t.tile_id)"]))


@query(_ENTITIES + " SELECT tile_id, roads, buildings, areas, pois FROM counts")
def entity_counts(spark, sf_dir):
    return manifest.entity_counts(entities(spark, sf_dir), BIG.specs(spark))


@query(_ENTITIES + f""" SELECT tile_id AS id, tile_id % {BIG.cols} AS grid_x, tile_id // {BIG.cols} AS grid_y, concat('tile_', tile_id) AS file, CASE WHEN tile_id % 3 = 0 THEN 7 ELSE 0 END::BIGINT AS file_size_bytes,
CAST({BIG.origin_x!r} + (tile_id % {BIG.cols}) * {BIG.size} AS BIGINT) AS origin_x, roads, pois FROM counts""")
def manifest_upsert(spark, sf_dir):
    counts = manifest.entity_counts(entities(spark, sf_dir), BIG.specs(spark))
    old = manifest.manifest_rows(counts, BIG)
    again = counts.filter(F.col("tile_id") % 3 == 0)
    new = manifest.manifest_rows(again, BIG, again.select("tile_id", F.lit(7).cast("bigint").alias("file_size_bytes")))
    merged = manifest.recover_manifest(BIG.specs(spark), manifest.upsert_manifest(old, new), old)
    return merged.select("id", "grid_x", "grid_y", "file", "file_size_bytes", F.col("origin_x_m").cast("bigint").alias("origin_x"), "entity_counts.roads", "entity_counts.pois")


@query(with_views("poi", more=f"""b AS (SELECT min({mx('lon')}) AS x0, min({my('lat')}) AS y0, max({mx('lon')}) AS x1, max({my('lat')}) AS y1, min(lat) AS a0, max(lon) AS o1 FROM poi),
g AS (SELECT *, floor(x0 / 50000) * 50000 AS ox, floor(y0 / 50000) * 50000 AS oy, ceil(greatest((x1 - x0) * (y1 - y0) / 1e6, 1)) AS chunks FROM b),
n AS (SELECT *, CAST(greatest(ceil((x1 - ox) / 50000), 1) AS BIGINT) AS cols, CAST(greatest(ceil((y1 - oy) / 50000), 1) AS BIGINT) AS tile_rows FROM g)""") + f"""
SELECT CAST(1 AS INT) AS version, 'region' AS region, CAST(chunks AS BIGINT) AS chunks, cols * tile_rows AS tile_count, greatest(CAST(ceil(log2(chunks / 1000)) AS INT) + 1, 2) AS lod_count, CAST(ox AS BIGINT) AS origin_x, CAST(oy AS BIGINT) AS origin_y,
  {cm('x0')} AS min_x_cm, {cm('y1')} AS max_y_cm, CAST(floor(a0 * 1e7 + 0.5e0) AS BIGINT) AS min_lat_e7, CAST(floor(o1 * 1e7 + 0.5e0) AS BIGINT) AS max_lon_e7,
  (SELECT string_agg(i, ',' ORDER BY i) FROM range(cols * tile_rows) r(i) WHERE i % 3 = 1) AS tile_ids FROM n""")
def index_document(spark, sf_dir):
    """The index over every third tile, whose rows arrive in any order."""
    found = scan_bounds(view(spark, sf_dir, "poi").select("lat", "lon"), 50_000)
    some = found.grid.specs(spark).select("tile_id").filter("tile_id % 3 = 1")
    none = spark.createDataFrame([], "tile_id bigint, lod int, layer string")
    rows = manifest.manifest_rows(manifest.entity_counts(none, some), found.grid).orderBy(F.xxhash64("id"))
    made, e7 = build_index(spark, found, "region", "source", rows), lambda c: F.floor(F.col(c) * 1e7 + 0.5).cast("bigint")
    return made.select(
        "version", "region", F.col("total_chunks_estimate").alias("chunks"), F.col("total_tile_count").alias("tile_count"), "lod_count", F.col("tile_grid.origin_x_m").cast("bigint").alias("origin_x"), F.col("tile_grid.origin_y_m").cast("bigint").alias("origin_y"),
        centimetres(F.col("world_bounds_mercator.min_x")).alias("min_x_cm"), centimetres(F.col("world_bounds_mercator.max_y")).alias("max_y_cm"), e7("world_bounds_lat_lon.min_lat").alias("min_lat_e7"), e7("world_bounds_lat_lon.max_lon").alias("max_lon_e7"),
        F.array_join(F.transform("tiles", lambda t: t["id"].cast("string")), ",").alias("tile_ids"))


@query(with_views("road_pt", "road", "poi", more=", ".join([
    envelopes("env", "road_pt"), _CLASSED, _POI_ENV.replace("env AS", "p_env AS"), tile_rows(BIG), LOD_ROWS,
    f"r AS (SELECT t.tile_id, lod FROM env e JOIN cls c ON c.way_id = e.way_id JOIN tiles t ON {meets(BIG)}, lods WHERE road_class IS NOT NULL AND lod <= {LAST_LOD_CASE})",
    f"p AS (SELECT t.tile_id, lod FROM p_env e JOIN tiles t ON {meets(BIG)}, lods WHERE lod < 4)"])) + """
SELECT coalesce(a.tile_id, b.tile_id) AS tile_id, coalesce(a.lod, b.lod) AS lod, coalesce(a.n, 0) AS n_roads, coalesce(b.n, 0) AS n_pois
FROM (SELECT tile_id, lod, CAST(count(*) AS INT) AS n FROM r GROUP BY ALL) a FULL JOIN (SELECT tile_id, lod, CAST(count(*) AS INT) AS n FROM p GROUP BY ALL) b ON a.tile_id = b.tile_id AND a.lod = b.lod""")
def tile_nested(spark, sf_dir):
    lods = lod_table(spark, N_LODS)
    roads = at_levels(boxes(spark, sf_dir, "road_pt").join(classed_roads(spark, sf_dir), "way_id"), lods).filter(road_visible(F.col("road_class"), F.col("lod")))
    pois = at_levels(poi_boxes(spark, sf_dir), lods).filter("lod < 4")
    layers = {"roads": tiling.assign_tiles(roads, BIG).select("tile_id", "lod", "way_id"), "pois": tiling.assign_tiles(pois, BIG).select("tile_id", "lod", "way_id")}
    rows = nested_tiles(layers, ("roads", "pois")).select("tile_id", F.explode("lods").alias("l"))
    return rows.select("tile_id", "l.lod", F.size("l.roads").alias("n_roads"), F.size("l.pois").alias("n_pois"))


@query(_ENTITIES + " SELECT layer, count(*) AS n FROM hits GROUP BY layer")
def layer_report(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


_COLOR_CASE = case([(f"road_class = {ROAD_CLASS[n]}", viewport.color_code(c)) for n, c in ROAD_COLOR.items()])
_TERRAIN_COLOR_CASE = case([(f"terrain = {TERRAIN[n]}", viewport.color_code(c)) for n, c in TERRAIN_COLOR.items()])


@query(with_views("road_pt", "road", more=f"""{_CLASSED}, p AS (SELECT way_id, pos, {cm(mx('lon'))} AS x0, {cm(my('lat'))} AS y0 FROM road_pt),
s AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY way_id ORDER BY pos))""") + f"""
SELECT s.way_id, pos, x0, y0, x1, y1, {_COLOR_CASE} AS color FROM s JOIN cls c ON c.way_id = s.way_id WHERE x1 IS NOT NULL AND road_class IS NOT NULL""")
def segments(spark, sf_dir):
    drawn = viewport.segments(points(spark, sf_dir, "road_pt"), ["way_id"]).join(classed_roads(spark, sf_dir), "way_id")
    return drawn.select("way_id", "pos", *(centimetres(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")), viewport.road_color(F.col("road_class")).alias("color"))


@query(with_views("area_pt", "area_tag", more=f"""{_BEST}, p AS (SELECT way_id, pos, {cm(mx('lon'))} AS x0, {cm(my('lat'))} AS y0 FROM area_pt),
s AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY way_id ORDER BY pos))""") + f"""
SELECT s.way_id, pos, x0, y0, x1, y1, {_TERRAIN_COLOR_CASE} AS color FROM s JOIN best b ON b.way_id = s.way_id WHERE x1 IS NOT NULL AND terrain IS NOT NULL""")
def area_outlines(spark, sf_dir):
    drawn = viewport.segments(points(spark, sf_dir, "area_pt"), ["way_id"]).join(terrain_best(spark, sf_dir).filter(F.col("terrain").isNotNull()), "way_id")
    return drawn.select("way_id", "pos", *(centimetres(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")), viewport.terrain_color(F.col("terrain")).alias("color"))


# ---------------------------------------------------------------- viewer


_CAMERA = with_views("camera", more=f"cam AS (SELECT user_id, event_id, ts, {mx('lon')} AS x, {my('lat')} AS y, scale FROM camera)")
_SPAN = (f"SELECT user_id, event_id, ts, greatest({_COL('x - scale * 640', GRID)} - 1, 0) AS c0, least({_COL('x + scale * 640', GRID)} + 1, {GRID.cols - 1}) AS c1, "
         f"greatest({_ROW('y - scale * 360', GRID)} - 1, 0) AS r0, least({_ROW('y + scale * 360', GRID)} + 1, {GRID.rows - 1}) AS r1 FROM cam")
_VISIBLE = f"vis AS (SELECT user_id, event_id, ts, y * {GRID.cols} + x AS tile_id FROM (SELECT *, unnest(range(r0, r1 + 1)) AS y FROM ({_SPAN})), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS x))"


@query(_CAMERA + ", " + _VISIBLE + " SELECT user_id, event_id, tile_id FROM vis")
def viewport_tiles(spark, sf_dir):
    return viewport.with_view(cameras(spark, sf_dir), GRID, LOD_DISTANCES_M).select("user_id", "event_id", F.explode("visible").alias("tile_id"))


_DISTANCES = [v.distance_m for v in LEVELS]
_LOD_CASE = case([(f"scale * 1280 * 0.5e0 <= {d!r}", i) for i, d in enumerate(_DISTANCES)], str(N_LODS - 1))


@query(_CAMERA + ", " + _VISIBLE + f""", n AS (SELECT event_id, count(*) AS n FROM vis GROUP BY event_id)
SELECT cam.event_id, concat_ws(chr(10), 'Region: region', printf('Player: %.0f, %.0f', x, y), printf('Scale: %.4f', scale), printf('LOD: %d', {_LOD_CASE}), printf('Loaded tiles: %d', coalesce(n, 0))) AS status
FROM cam LEFT JOIN n ON n.event_id = cam.event_id""")
def debug_status(spark, sf_dir):
    rows = viewport.with_view(cameras(spark, sf_dir), GRID, _DISTANCES)
    return rows.select("event_id", viewport.status_text(F.lit("region"), F.col("x"), F.col("y"), F.col("scale"), F.col("lod"), F.size("visible")).alias("status"))


@query(with_views("camera") + " SELECT event_id, " + case([(f"scale * 16 * 1280 * 0.5e0 <= {d!r}", i) for i, d in enumerate(_DISTANCES)], str(N_LODS - 1)) + " AS lod FROM camera")
def lod_select(spark, sf_dir):
    return cameras(spark, sf_dir).select("event_id", lod_for_radius(F.col("scale") * 16 * 1280 * 0.5, _DISTANCES).alias("lod"))


@query(f"""WITH b AS (SELECT {mx('88e0')} AS x0, {my('20.5e0')} AS y0, {mx('92.5e0')} AS x1, {my('26.5e0')} AS y1), w AS (SELECT * FROM (VALUES (1280, 720), (1920, 1080), (800, 1200)) t(width, height)),
s AS (SELECT *, 800e0 / width AS playable, greatest((x1 - x0) / width, (y1 - y0) / height) * 1.08e0 AS fit, 50e0 / greatest(width, height) AS near, 1000000e0 / greatest(width, height) AS far FROM b, w),
m AS (SELECT *, least(near, playable) AS lo, greatest(far, fit, least(near, playable)) AS hi FROM s)
SELECT width, height, CAST(floor(lo * 1e6 + 0.5e0) AS BIGINT) AS min_scale_e6, CAST(floor(hi * 1e6 + 0.5e0) AS BIGINT) AS max_scale_e6, CAST(floor(least(greatest(playable, lo), hi) * 1e6 + 0.5e0) AS BIGINT) AS scale_e6,
  {cm('(x0 + x1) * 0.5e0')} AS start_x_cm, {cm('(y0 + y1) * 0.5e0')} AS start_y_cm FROM m""")
def viewer_init(spark, sf_dir):
    box_ = [mercator_x(F.lit(LON[0])), mercator_y(F.lit(LAT[0])), mercator_x(F.lit(LON[1])), mercator_y(F.lit(LAT[1]))]
    index = spark.range(1).select(*(c.alias(n) for c, n in zip(box_, ("min_x", "min_y", "max_x", "max_y"))), F.array(*map(F.lit, _DISTANCES)).alias("distances"))
    start = viewport.viewer_start(index, spark.createDataFrame([(1280, 720), (1920, 1080), (800, 1200)], "width int, height int"))
    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(f"{c}_e6")
    return start.select("width", "height", e6("min_scale"), e6("max_scale"), e6("scale"), centimetres(F.col("start_x")).alias("start_x_cm"), centimetres(F.col("start_y")).alias("start_y_cm"))


@query("""WITH d AS (SELECT user_id, event_id, ts, CAST(event_id % 3 - 1 AS DOUBLE) AS dx, CAST(event_id % 2 AS DOUBLE) AS dy, CAST(event_id % 5 + 1 AS DOUBLE) / 60 AS dt FROM events),
s AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) * 900 * dt ELSE 0 END AS sx, CASE WHEN dx <> 0 OR dy <> 0 THEN dy / sqrt(dx * dx + dy * dy) * 900 * dt ELSE 0 END AS sy FROM d)
SELECT user_id, event_id, CAST(floor(sum(sx) OVER w * 1000 + 0.25e0) AS BIGINT) AS x_mm, CAST(floor(sum(sy) OVER w * 1000 + 0.25e0) AS BIGINT) AS y_mm FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def player_path(spark, sf_dir):
    e = F.col("event_id")
    inputs = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", (e % 3 - 1).cast("double").alias("dir_x"), (e % 2).cast("double").alias("dir_y"), ((e % 5 + 1).cast("double") / 60).alias("dt"))
    mm = lambda c: F.floor(F.col(c) * 1000 + 0.25).cast("bigint")  # noqa: E731  a quarter: sums of whole steps lie on halves
    return viewport.move_path(inputs, "user_id", ["ts", "event_id"]).select("user_id", "event_id", mm("x").alias("x_mm"), mm("y").alias("y_mm"))


@query("""WITH RECURSIVE f AS (SELECT user_id, CAST(event_id % 7 - 3 AS DOUBLE) AS scroll, CAST(event_id % 4 + 1 AS DOUBLE) / 60 AS dt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
z(user_id, i, target, scale) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 0.625e0, 0.625e0 FROM f
  UNION ALL SELECT z.user_id, f.i, t.target, z.scale + (t.target - z.scale) * (1 - exp(-8 * f.dt)) FROM z JOIN f ON f.user_id = z.user_id AND f.i = z.i + 1,
    LATERAL (SELECT CASE WHEN abs(f.scroll) <= 1.1920929e-07 THEN z.target ELSE least(greatest(z.target * pow(2e0, -f.scroll * 0.25e0), 0.0390625e0), 100e0) END AS target) t)
SELECT user_id, CAST(floor(target * 1e6 + 0.5e0) AS BIGINT) AS target_e6, CAST(floor(scale * 1e6 + 0.5e0) AS BIGINT) AS scale_e6, i AS frames FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def zoom_fold(spark, sf_dir):
    e = F.col("event_id")
    inputs = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", (e % 7 - 3).cast("double").alias("scroll"), ((e % 4 + 1).cast("double") / 60).alias("dt"))
    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint")
    return viewport.zoom_fold(inputs, "user_id", ["ts", "event_id"], 0.625, 0.0390625, 100.0).select("user_id", e6("target_scale").alias("target_e6"), e6("scale").alias("scale_e6"), "frames")


# a fifth of the tiles are not baked, and every third open fails
_DELTAS = _CAMERA + ", " + _VISIBLE + """, f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM cam),
w AS (SELECT f.user_id, f.event_id, f.i, v.tile_id, f.i - row_number() OVER (PARTITION BY f.user_id, v.tile_id ORDER BY f.i) AS run FROM vis v JOIN f ON f.event_id = v.event_id WHERE v.tile_id % 5 <> 0),
r AS (SELECT user_id, tile_id, run, min(i) FILTER (WHERE (event_id + tile_id) % 3 <> 0) AS a, max(i) + 1 AS b FROM w GROUP BY user_id, tile_id, run)
SELECT r.user_id, f.event_id, 'load' AS action, r.tile_id FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.a
UNION ALL SELECT r.user_id, f.event_id, 'evict', r.tile_id FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.b WHERE r.a IS NOT NULL"""


def _available(spark: SparkSession) -> DataFrame:
    return GRID.specs(spark).select("tile_id").filter("tile_id % 5 <> 0")


def _opens() -> Column:
    return (F.col("event_id") + F.col("tile_id")) % 3 != 0


@query(_DELTAS)
def tile_load_evict(spark, sf_dir):
    return viewport.load_evict(viewport.with_view(cameras(spark, sf_dir), GRID, LOD_DISTANCES_M), "user_id", ["ts", "event_id"], "event_id", _available(spark), _opens())


@query(_DELTAS)
def tile_load_evict_stream(spark, sf_dir):
    """The stream reads the events folder as it is and is run until it has seen everything."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = scratch(spark)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = spark.sql(VIEWS["camera"].replace("FROM events", "FROM {events}"), events=events)
    rows = rows.select("user_id", "event_id", "ts", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"), "scale")
    seen = viewport.with_view(rows, GRID, LOD_DISTANCES_M).select("user_id", "ts", "event_id", "lod", "visible")
    frames = viewport.load_evict_stream(viewport.desired(seen, _available(spark), _opens()))
    run = frames.writeStream.format("parquet").option("path", f"{folder}/frames").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(viewport.FRAME).parquet(f"{folder}/frames")
    load = done.select("user_id", "event_id", F.lit("load").alias("action"), F.explode("load").alias("tile_id"))
    return load.unionByName(done.select("user_id", "event_id", F.lit("evict").alias("action"), F.explode("evict").alias("tile_id")))


@query(with_views("camera", more=f"cam AS (SELECT user_id, event_id, ts, {mx('lon')} AS x, {my('lat')} AS y, scale FROM camera)") + f"""
SELECT event_id, {cm('CASE WHEN event_id % 4 = 0 THEN x ELSE event_id * 0.5e0 END')} AS x_cm, {cm('CASE WHEN event_id % 4 = 0 THEN y ELSE event_id * -0.25e0 END')} AS y_cm, CAST(scale * 1000 AS BIGINT) AS scale_e3 FROM cam""")
def follow_camera(spark, sf_dir):
    """Every fourth camera has no player."""
    seen = cameras(spark, sf_dir)
    players = seen.filter("event_id % 4 <> 0").select("event_id", (F.col("event_id") * 0.5).alias("x"), (F.col("event_id") * -0.25).alias("y"))
    return viewport.follow(seen, players, ["event_id"]).select("event_id", centimetres(F.col("x")).alias("x_cm"), centimetres(F.col("y")).alias("y_cm"), (F.col("scale") * 1000).cast("bigint").alias("scale_e3"))


@query(with_views("road_pt", "road", more=", ".join([
    envelopes("env", "road_pt"), _CLASSED, tile_rows(BIG), LOD_ROWS,
    f"r AS (SELECT t.tile_id, lod, count(*) AS n FROM env e JOIN cls c ON c.way_id = e.way_id JOIN tiles t ON {meets(BIG)}, lods WHERE road_class IS NOT NULL AND lod <= {LAST_LOD_CASE} GROUP BY t.tile_id, lod)",
    "p AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY lod) - 1 AS place, count(*) OVER (PARTITION BY tile_id) AS places FROM r)"])) + f"""
SELECT tile_id, CAST(w AS INT) AS wanted, lod AS drawn, CAST(n AS INT) AS n_roads FROM p, range({N_LODS} + 3) t(w) WHERE place = least(w, places - 1)""")
def drawn_level(spark, sf_dir):
    """The level that is drawn of a tile for every level wanted, also beyond its last one."""
    roads = at_levels(boxes(spark, sf_dir, "road_pt").join(classed_roads(spark, sf_dir), "way_id"), lod_table(spark, N_LODS)).filter(road_visible(F.col("road_class"), F.col("lod")))
    nested = nested_tiles({"roads": tiling.assign_tiles(roads, BIG).select("tile_id", "lod", "way_id")}, ("roads",))
    rows = nested.withColumn("wanted", F.explode(F.sequence(F.lit(0), F.lit(N_LODS + 2)))).withColumn("l", viewport.lod_or_last(F.col("lods"), F.col("wanted")))
    return rows.select("tile_id", "wanted", F.col("l.lod").alias("drawn"), F.size("l.roads").alias("n_roads"))


# ---------------------------------------------------------------- files


def _extract(spark: SparkSession, sf_dir: str) -> tuple[list, list, list]:
    """Customers as nodes, nations as ways through all of their customers, regions as relations. The writers of the two
    formats run on the driver, so this is a fixture for reading, no way to export."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").select("c_custkey", "c_nationkey", "c_name").collect()
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()
    nodes = [(c[0], 20.5 + c[0] % 1000 / 125, 88 + c[0] % 777 / 125, [("name", c[2]), ("place", "town")][: c[0] % 3]) for c in customers]
    refs: dict[int, list[int]] = {n["n_nationkey"]: [] for n in nations}
    for c in customers:
        refs[c[1]].append(c[0])
    ways = [(n["n_nationkey"] + 100, refs[n["n_nationkey"]], [("highway", "service"), ("name", n["n_name"])]) for n in nations]
    members = lambda r: [("way", n["n_nationkey"] + 100, "outer") for n in nations if n["n_regionkey"] == r] + [("node", r, "")]
    return nodes, ways, [(r["r_regionkey"] + 200, members(r["r_regionkey"]), [("type", "multipolygon")]) for r in regions]


def _flat(found: dict[str, DataFrame]) -> DataFrame:
    tag = lambda t: F.concat_ws(",", F.transform(t, lambda x: F.concat_ws("=", x["k"], x["v"])))
    node = found["node"].select(F.lit("node").alias("element"), "id", F.concat_ws(" ", F.floor(F.col("lat") * 1e7 + 0.5).cast("bigint"), F.floor(F.col("lon") * 1e7 + 0.5).cast("bigint")).alias("body"), tag("tags").alias("tags"))
    way = found["way"].select(F.lit("way").alias("element"), "id", F.concat_ws(" ", F.transform("refs", lambda r: r.cast("string"))).alias("body"), tag("tags").alias("tags"))
    rel = found["relation"].select(F.lit("relation").alias("element"), "id", F.concat_ws(" ", F.transform("members", lambda m: F.concat_ws(":", m["type"], m["ref"], F.coalesce(m["role"], F.lit(""))))).alias("body"), tag("tags").alias("tags"))
    return node.unionByName(way).unionByName(rel)


_FLAT = """SELECT 'node' AS element, CAST(c_custkey AS BIGINT) AS id, concat(CAST(floor((20.5e0 + c_custkey % 1000 / 125e0) * 1e7 + 0.5e0) AS BIGINT), ' ', CAST(floor((88 + c_custkey % 777 / 125e0) * 1e7 + 0.5e0) AS BIGINT)) AS body,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('name=', c_name) ELSE concat('name=', c_name, ',place=town') END AS tags FROM customer
UNION ALL SELECT 'way', n_nationkey + 100, coalesce((SELECT string_agg(c_custkey, ' ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), ''), concat('highway=service,name=', n_name) FROM nation
UNION ALL SELECT 'relation', r_regionkey + 200, concat((SELECT string_agg(concat('way:', n_nationkey + 100, ':outer'), ' ' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), ' node:', r_regionkey, ':'), 'type=multipolygon' FROM region"""


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    path = f"{scratch(spark)}/{name}"
    put_file(spark, path, data)
    return path


@query(_FLAT)
def osm_pbf_read(spark, sf_dir):
    return _flat(osm.read_osm_pbf(spark, _put(spark, "extract.osm.pbf", osm.encode_pbf(*_extract(spark, sf_dir), block=1000))))


@query(_FLAT)
def osm_xml_read(spark, sf_dir):
    from xml.sax.saxutils import quoteattr as q

    nodes, ways, rels = _extract(spark, sf_dir)
    tag = lambda ts: "".join(f"<tag k={q(k)} v={q(v)}/>" for k, v in ts)
    body = [f'<node id="{i}" lat="{lat!r}" lon="{lon!r}">{tag(t)}</node>' for i, lat, lon, t in nodes]
    body += [f'<way id="{i}">{"".join(f"<nd ref={q(str(r))}/>" for r in refs)}{tag(t)}</way>' for i, refs, t in ways]
    body += [f'<relation id="{i}">{"".join(f"<member type={q(a)} ref={q(str(b))} role={q(c)}/>" for a, b, c in ms)}{tag(t)}</relation>' for i, ms, t in rels]
    return _flat(osm.read_osm_xml(spark, _put(spark, "extract.osm", ("<osm>\n" + "\n".join(body) + "\n</osm>\n").encode())))


@query(with_views("road_pt", "road", more=", ".join([envelopes("env", "road_pt"), tile_rows(BIG), _CLASSED])) + f"""
SELECT t.tile_id, c.road_class, count(*) AS n FROM env e JOIN cls c ON c.way_id = e.way_id JOIN tiles t ON {meets(BIG)} WHERE (e.min_x < e.max_x OR e.min_y < e.max_y) AND c.road_class IS NOT NULL GROUP BY t.tile_id, c.road_class""")
def tile_roundtrip(spark, sf_dir):
    """Roads (those with two different points) are baked, written by level and tile, and read back at level 0."""
    shapes = resolve.with_envelope(resolve.point_arrays(points(spark, sf_dir, "road_pt"), "way_id"))
    roads = shapes.join(classed_roads(spark, sf_dir), "way_id").withColumnRenamed("way_id", "feature_id")
    none = roads.limit(0).withColumns({"terrain": F.lit(1), "kind": F.lit(""), "name": F.lit("")})
    root = scratch(spark)
    tiles.write_layers(bake_layers({"roads": roads, "areas": none, "buildings": none, "pois": none}, BIG, lod_table(spark, 2)), root, "region")
    stored = tiles.read_layer(spark, root, "region", "roads").filter("lod = 0")
    return stored.groupBy("tile_id", F.col("class").alias("road_class")).agg(F.count(F.lit(1)).alias("n"))
