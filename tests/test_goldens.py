"""Cases worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from tilespark.functions import classify as C
from tilespark.functions.geometry import register, segments_meet, simplify_preserve, snap_ring, stitch_rings, union_rings, valid_ring
from tilespark.functions.grid import Grid, parse_tile_ids, tile_ids_of_ranges
from tilespark.functions.lod import Lod, lod_count
from tilespark.functions.project import mercator_point, mercator_x, mercator_y
from tilespark.schema import LOD_DISTANCES_M, OSM_WAY, ROAD_CLASS, TERRAIN
from tilespark.streaming.viewport import load_evict, viewer_start, with_view

GRID = Grid.from_lat_lon(20.5, 88.0, 26.5, 92.5, 100_000)


@pytest.mark.parametrize("segments, rings", [
    ([[1, 2, 3, 1]], [[1, 2, 3, 1]]), ([[1, 2, 3], [3, 4, 1]], [[3, 4, 1, 2, 3]]), ([[1, 2, 3], [1, 4, 3]], [[1, 4, 3, 2, 1]]),
    ([[1, 2, 3], [5, 4, 3], [5, 6, 1]], [[5, 6, 1, 2, 3, 4, 5]]), ([[1, 2, 3]], []), ([[1, 2, 3], [10, 11, 12, 10], [3, 4, 1]], [[3, 4, 1, 2, 3], [10, 11, 12, 10]]),
    ([[1, 2, 1]], []), ([[1, 2], [2, 3], [9, 1]], []), ([[1, 2, 3], [1, 2, 3], [3, 4, 1]], [[3, 4, 1, 2, 3]]), ([[1, 2, 3], [3, 4, 1], [3, 5, 1]], [[3, 5, 1, 2, 3]]), ([], []),
])
def test_stitching(segments, rings):
    assert stitch_rings(segments) == rings


@pytest.mark.parametrize("lat, lon, x, y", [(23.7, 90.4, 10063281.9677, 2716894.1810), (20.5, 88.0, 9796115.1898, 2332357.8126), (26.5, 92.5, 10297052.8984, 3061141.0389), (90, 180, 20037508.3428, 20037508.3430)])
def test_mercator(spark, lat, lon, x, y):
    assert mercator_point(lat, lon) == pytest.approx((x, y), abs=1e-3)
    row = spark.range(1).select(mercator_x(F.lit(float(lon))), mercator_y(F.lit(float(lat)))).first()
    assert tuple(row) == pytest.approx((x, y), abs=1e-3)


def test_grid(spark):
    assert (GRID.origin_x, GRID.origin_y, GRID.cols, GRID.rows) == (9_700_000, 2_300_000, 6, 8)
    ids = lambda *box: spark.range(1).select(GRID.ids_for_lat_lon_box(*(F.lit(float(v)) for v in box))).first()[0]
    assert ids(23.7, 90.4, 23.7, 90.4) == [27]
    assert ids(0, 0, 1, 1) == [0]
    assert ids(26.5, 92.5, 20.5, 88) == ids(20.5, 88, 26.5, 92.5)
    with pytest.raises(ValueError):
        Grid.from_bounds(0, 0, 1, 1, 0)
    assert Grid.from_bounds(5, 5, 5, 5, 10).count == 1


@pytest.mark.parametrize("text, ids", [("1, 3-5,4", [1, 3, 4, 5]), ("", []), (" , ", []), ("7-7", [7])])
def test_tile_ids(spark, text, ids):
    assert parse_tile_ids(text, 47) == ids
    assert spark.createDataFrame([(text,)], "t string").select(tile_ids_of_ranges(F.col("t"), 47)).first()[0] == ids


@pytest.mark.parametrize("text", ["5-3", "48", "x", "1-"])
def test_tile_ids_wrong(spark, text):
    with pytest.raises(ValueError):
        parse_tile_ids(text, 47)
    with pytest.raises(Exception, match="not a tile id"):
        spark.createDataFrame([(text,)], "t string").select(tile_ids_of_ranges(F.col("t"), 47)).first()


def test_levels():
    assert [lod_count(n) for n in (1, 1000, 1001, 2000, 2001, 4000, 100000, 400000, 1000000)] == [2, 2, 2, 2, 3, 3, 8, 10, 11]
    levels = Lod.levels(9)
    assert [round(v.min_building_box) for v in levels[:4]] == [8, 6, 6, 150] and levels[8].tolerance_m == 500 and levels[1].epsilon == pytest.approx(0.04000000283, abs=1e-10)


@pytest.mark.parametrize("tags, expected", [
    ([("building", "no"), ("highway", "primary")], ("building", None, None)), ([("highway", "primary"), ("area", "yes"), ("landuse", "grass")], ("area", "Grass", None)),
    ([("highway", "footway"), ("natural", "water")], ("area", "Water", None)), ([("highway", "footway")], None), ([("landuse", "forest"), ("natural", "beach")], ("area", "Sand", None)),
    ([("landuse", "forest"), ("amenity", "school")], ("area", "Urban", None)), ([("highway", "trunk_link")], ("road", None, "Motorway")), ([], None),
])
def test_way_kind(spark, tags, expected):
    row = spark.createDataFrame([(1, [], tags)], OSM_WAY).select(C.way_kind(F.col("tags")).alias("k")).first()["k"]
    if expected is None:
        assert row is None
    else:
        layer, terrain, road = expected
        assert (row["layer"], row["terrain"], row["road_class"]) == (layer, terrain and TERRAIN[terrain], None if road is None else ROAD_CLASS[road])


@pytest.mark.parametrize("tags, kind, name", [
    ([("tourism", "hotel"), ("amenity", "cafe"), ("name", "X")], "tourism:hotel", "X"), ([("place", "hamlet")], None, None), ([("railway", "halt"), ("aeroway", "aerodrome")], "aeroway:aerodrome", None),
])
def test_poi(spark, tags, kind, name):
    assert tuple(spark.createDataFrame([(1, [], tags)], OSM_WAY).select(C.poi_kind(F.col("tags")), C.poi_name(F.col("tags"))).first()) == (kind, name)


@pytest.mark.parametrize("tags, terrain", [([("type", "multipolygon"), ("building", "yes")], "Urban"), ([("type", "route"), ("natural", "water")], None)])
def test_relation(spark, tags, terrain):
    assert spark.createDataFrame([(1, [], tags)], OSM_WAY).select(C.relation_terrain(F.col("tags"))).first()[0] == (terrain and TERRAIN[terrain])


def test_viewport(spark):
    camera = spark.createDataFrame([(10063281.97, 2716894.18, 0.625), (0.0, 0.0, 0.625)], "x double, y double, scale double")
    rows = with_view(camera, GRID, LOD_DISTANCES_M).collect()
    assert rows[0]["visible"] == [20, 21, 22, 26, 27, 28, 32, 33, 34] and rows[0]["lod"] == 2
    assert rows[1]["visible"] == []


def test_viewer_start(spark):
    low, high = mercator_point(20.5, 88.0), mercator_point(26.5, 92.5)
    index = spark.createDataFrame([(*low, *high, [v.distance_m for v in Lod.levels(10)])], "min_x double, min_y double, max_x double, max_y double, distances array<double>")
    row = viewer_start(index, spark.createDataFrame([(1280, 720)], "width int, height int")).first()
    assert (row["scale"], row["min_scale"]) == (0.625, 0.0390625) and row["max_scale"] == pytest.approx(1093.1748, abs=1e-3)


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def test_validity():
    assert valid_ring(SQUARE) and not valid_ring(SQUARE[:-1]) and not valid_ring([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]) and not valid_ring([(0, 0), (1, 0), (2, 0), (0, 0)])
    assert not valid_ring([(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (0.0, 0.0)]) and not valid_ring([])
    assert segments_meet((0, 0), (2, 0), (1, 0), (1, 1)) and not segments_meet((0, 0), (1, 0), (2, 0), (3, 0))


def test_simplify_and_snap():
    assert simplify_preserve([(0, 0), (1, 0.01), (2, 0)], 1.0, False) == [(0, 0), (2, 0)]
    assert simplify_preserve(SQUARE, 1e9, True) == [p for p in simplify_preserve(SQUARE, 1e9, True)] and len(simplify_preserve(SQUARE, 1e9, True)) == 4
    assert snap_ring([(0.4, 0.4), (4.4, 0.4), (4.4, 4.4), (0.4, 0.4)], 1.0) == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    assert snap_ring([(0.1, 0.1), (0.3, 0.1), (0.2, 0.3), (0.1, 0.1)], 1.0) is None


def test_union():
    shift = lambda dx, dy: [(x + dx, y + dy) for x, y in SQUARE]
    assert len(union_rings([SQUARE, shift(4, 4)], 1.0)) == 2  # touching at a corner
    assert union_rings([SQUARE, shift(4, 0)], 1.0) == [[(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    frame = [[(0, 0), (6, 0), (6, 1), (0, 1), (0, 0)], [(0, 0), (1, 0), (1, 6), (0, 6), (0, 0)], [(5, 0), (6, 0), (6, 6), (5, 6), (5, 0)], [(0, 5), (6, 5), (6, 6), (0, 6), (0, 5)]]
    assert union_rings(frame, 1.0) == [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0)]]  # the hole is filled


def test_kernels_by_name(spark):
    register(spark)
    square = "named_struct('xs', array(0D, 2D, 2D, 0D, 0D), 'ys', array(0D, 0D, 2D, 2D, 0D))"
    moved = "named_struct('xs', array(1D, 3D, 3D, 1D, 1D), 'ys', array(0D, 0D, 2D, 2D, 0D))"
    row = spark.sql(f"""SELECT union_rings(array({square}, {moved}), 1D) AS u, snap_ring(array(0.2D, 4.1D, 4D, 0.2D), array(0D, 0D, 3.9D, 0D), 2D) AS s,
      drop_repeats(array(1D, 1D, 2D), array(1D, 1D, 1D)) AS d, is_valid_ring(array(0D, 1D, 1D, 0D), array(0D, 0D, 1D, 0D)) AS v, stitch_rings(array(array(1L, 2L, 3L), array(3L, 4L, 1L))) AS r""").first()
    assert len(row["u"]) == 1 and set(zip(row["u"][0]["xs"], row["u"][0]["ys"])) == {(0, 0), (3, 0), (3, 2), (0, 2)}
    assert (row["s"]["xs"], row["s"]["ys"]) == ([0, 4, 4, 0], [0, 0, 4, 0]) and (row["d"]["xs"], row["d"]["ys"]) == ([1, 2], [1, 1])
    assert row["v"] and len(row["r"]) == 1 and set(row["r"][0]) == {1, 2, 3, 4}


def test_simplification_is_evaluated_once(spark):
    """One evaluation in the plan, though a filter and several fields read its result."""
    from tilespark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    for name in ("simplify_vw", "building_dissolve"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("simplify_udf(") == 1, name


def test_failed_opens_are_tried_again(spark):
    rows = [(1, 1, [5, 6]), (1, 2, [5, 6, 7]), (1, 3, [6]), (1, 4, []), (1, 5, [5, 6])]
    views = spark.createDataFrame([(u, e, e, 0, v) for u, e, v in rows], "user_id long, event_id long, ts long, lod int, visible array<long>")
    available = spark.createDataFrame([(5,), (6,)], "tile_id long")
    opens = ~((F.col("event_id") == 1) & (F.col("tile_id") == 6))
    got = sorted(tuple(r) for r in load_evict(views, "user_id", ["ts"], "event_id", available, opens).select("event_id", "action", "tile_id").collect())
    assert got == [(1, "load", 5), (2, "load", 6), (3, "evict", 5), (4, "evict", 6), (5, "load", 5), (5, "load", 6)]
    assert {r["tile_id"] for r in load_evict(views, "user_id", ["ts"], "event_id").collect()} == {5, 6, 7}
