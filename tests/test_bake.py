"""From an extract to tiles on disk and back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tilespark.api import bake, extract_features, read_index, read_layer, read_osm_pbf, scan_bounds
from tilespark.operators.tiling import selected_tiles
from tilespark.operators.resolve import needed_nodes
from tilespark.plans.bake import bake_layers, nested_tiles, resolve_shapes
from tilespark.functions.lod import lod_table
from tilespark.streaming.viewport import drawn, lod_or_last
from tilespark.schema import OSM_NODE, OSM_RELATION, OSM_WAY
from tilespark.sources.osm import encode_pbf
from tilespark.sources.store import put_file
from tilespark.sources.tiles import index_path, index_rows


def town():
    """Four corners of a square kilometre, a road across, a house, a pond as a relation of two ways, and a cafe."""
    lat, lon = 23.7, 90.4
    at = lambda i, x, y, tags=(): (i, lat + y * 1e-5, lon + x * 1e-5, list(tags))
    nodes = [at(1, 0, 0), at(2, 900, 0), at(3, 900, 900), at(4, 0, 900), at(5, 450, 450, [("amenity", "cafe"), ("name", "Corner")])]
    nodes += [at(10, 100, 100), at(11, 120, 100), at(12, 120, 120), at(13, 100, 120), at(20, 300, 300), at(21, 400, 300), at(22, 400, 400), at(23, 300, 400)]
    ways = [
        (100, [1, 5, 3], [("highway", "primary")]), (101, [10, 11, 12, 13, 10], [("building", "yes")]), (102, [1, 2, 3, 4, 1], [("landuse", "forest")]),
        (103, [20, 21, 22], []), (104, [22, 23, 20], []), (105, [1, 99], [("highway", "service")]), (106, [10, 11, 12], [("building", "yes")]),
    ]
    relations = [(200, [("way", 103, "outer"), ("way", 104, ""), ("way", 102, "inner"), ("node", 5, "label")], [("type", "multipolygon"), ("natural", "water")])]
    return nodes, ways, relations


@pytest.fixture(scope="module")
def elements(spark):
    nodes, ways, relations = town()
    return {"node": spark.createDataFrame(nodes, OSM_NODE), "way": spark.createDataFrame(ways, OSM_WAY), "relation": spark.createDataFrame(relations, OSM_RELATION)}


def test_features(elements):
    found = extract_features(elements["node"], elements["way"], elements["relation"])
    assert {r["feature_id"] for r in found["roads"].collect()} == {100}  # 105 lacks a node
    assert {r["feature_id"] for r in found["buildings"].collect()} == {101}  # 106 is open
    assert {(r["feature_id"], r["terrain"]) for r in found["areas"].collect()} == {(102, 3), (-200, 1)}
    assert [(r["kind"], r["name"]) for r in found["pois"].collect()] == [("amenity:cafe", "Corner")]


def test_no_nodes_is_an_error(elements):
    with pytest.raises(ValueError):
        scan_bounds(elements["node"].limit(0))


def test_bake_and_rebake(spark, elements, tmp_path):
    root = str(tmp_path)
    index = bake(elements, root, "town", source="town.pbf", tile_size=500).first()
    grid, tiles = index["tile_grid"], {t["id"]: t for t in index["tiles"]}
    assert index["version"] == 1 and index["lod_count"] == 2 and len(tiles) == index["total_tile_count"] == grid["cols"] * grid["rows"]
    assert sum(t["entity_counts"]["pois"] for t in tiles.values()) >= 1 and all(t["file_size_bytes"] > 0 for t in tiles.values() if t["entity_counts"]["areas"])
    roads = read_layer(spark, root, "town", "roads")
    assert roads.filter("lod = 0").select(F.min("width_m")).first()[0] == 11.0 and roads.filter("lod = 1").select(F.min("width_m")).first()[0] == pytest.approx(9.8214, abs=1e-4)
    before = {n: read_layer(spark, root, "town", n).count() for n in ("roads", "areas", "buildings", "pois")}
    again = bake(elements, root, "town", source="town.pbf", tile_size=500, tile_ids=[0]).first()
    assert {n: read_layer(spark, root, "town", n).count() for n in before} == before
    assert [t["id"] for t in again["tiles"]] == sorted(tiles)
    document = json.load(open(os.path.join(root, "map/town/index.json")))
    assert document["tile_grid"]["tile_size_m"] == 500 and read_index(spark, root, "town").first()["region"] == "town"


def test_bake_on_a_uri_keeps_old_origins(spark, elements, tmp_path):
    root = f"file:{tmp_path}/maps"
    bake(elements, root, "town", tile_size=500)
    rows = [r.asDict(recursive=True) for r in index_rows(spark, root, "town").collect()]
    moved = [{**r, "origin_x_m": 7.0} if r["id"] == 1 else r for r in rows]
    document = json.load(open(tmp_path / "maps/map/town/index.json"))
    put_file(spark, index_path(root, "town"), json.dumps({**document, "tiles": moved}).encode())
    again = {t["id"]: t for t in bake(elements, root, "town", tile_size=500, tile_ids=[0]).first()["tiles"]}
    assert again[1]["origin_x_m"] == 7.0 and again[0]["origin_x_m"] == rows[0]["origin_x_m"] and len(again) == len(rows)
    assert not [n for n in os.listdir(tmp_path / "maps/map/town") if n.startswith("_draft") or n.endswith(".tmp")]
    put_file(spark, index_path(root, "town"), b'{"tiles": [{"id": "no number"')
    with pytest.raises(Exception):
        bake(elements, root, "town", tile_size=500)


def test_nodes_are_joined_once(spark, elements):
    """Areas, buildings and roads come from one join with the nodes, and only needed nodes are exchanged."""
    shapes = resolve_shapes(elements["node"], elements["way"], elements["relation"])
    assert {r["layer"] for r in shapes.collect()} == {"area", "building", "road"}
    refs = spark.createDataFrame([(1,), (3,), (10**12,)], "node_id long")
    nodes = spark.range(5000).select(F.col("id"))
    kept = {r["id"] for r in needed_nodes(nodes, refs).collect()}
    assert {1, 3} <= kept and len(kept) < 10


def test_selection(spark, elements):
    scan = scan_bounds(elements["node"], 500)
    ids = lambda **kw: sorted(r["tile_id"] for r in selected_tiles(scan.grid, spark, **kw).collect())
    assert ids(tile_ids=[1, 0, 1]) == [0, 1] and ids(tile_ids=[0], lat_lon_box=(0, 0, 1, 1)) == [0] and len(ids()) == scan.grid.count and ids(lat_lon_box=(0, 0, 1, 1)) == [0]


def test_nested(spark, elements):
    scan = scan_bounds(elements["node"], 500)
    layers = bake_layers(extract_features(elements["node"], elements["way"], elements["relation"]), scan.grid, lod_table(spark, 2))
    rows = nested_tiles(layers).collect()
    assert all([lod["lod"] for lod in r["lods"]] == sorted(lod["lod"] for lod in r["lods"]) for r in rows)
    assert sum(len(lod["roads"]) for r in rows for lod in r["lods"]) == layers["roads"].count()


def test_drawing(spark, elements):
    scan = scan_bounds(elements["node"], 500)
    layers = bake_layers(extract_features(elements["node"], elements["way"], elements["relation"]), scan.grid, lod_table(spark, 2))
    rows = drawn(layers, scan.grid, 0).collect()
    assert {r["layer"] for r in rows} == {"areas", "buildings", "roads", "pois"} and {r["color"] for r in rows if r["layer"] == "areas"} == {103268, 73416}
    assert all(r["radius"] == 18.0 and r["x0"] == r["x1"] for r in rows if r["layer"] == "pois")
    nested = nested_tiles(layers).select(lod_or_last(F.col("lods"), F.lit(9))["lod"].alias("lod")).collect()
    assert {r["lod"] for r in nested} <= {0, 1}


def test_pbf_round_trip(spark, tmp_path):
    nodes, ways, relations = town()
    path = tmp_path / "town.osm.pbf"
    path.write_bytes(encode_pbf(nodes, ways, relations, block=4))
    found = read_osm_pbf(spark, str(path))
    assert sorted((r["id"], round(r["lat"], 7), round(r["lon"], 7), [tuple(t) for t in r["tags"]]) for r in found["node"].collect()) == sorted((i, round(a, 7), round(b, 7), t) for i, a, b, t in nodes)
    assert sorted((r["id"], r["refs"], [tuple(t) for t in r["tags"]]) for r in found["way"].collect()) == sorted(ways)
    assert [(r["id"], [tuple(m) for m in r["members"]], [tuple(t) for t in r["tags"]]) for r in found["relation"].collect()] == relations


def test_pbf_of_many_blocks(spark, tmp_path):
    nodes = [(i * 3 - 5000, 20 + i / 1000, -90 + i / 1000, [("ref", str(i)), ("name", "ä" * (i % 4))] if i % 7 == 0 else []) for i in range(5000)]
    ways = [(10**10 + i, [i * 7, i, -i, 2 * i][: i % 5], [("highway", "service")] * (i % 2)) for i in range(900)]
    path = tmp_path / "many.osm.pbf"
    path.write_bytes(encode_pbf(nodes, ways, [], block=640))
    found = {k: v for k, v in read_osm_pbf(spark, str(path)).items()}
    assert sorted((r["id"], round(r["lat"], 7), round(r["lon"], 7), [tuple(t) for t in r["tags"]]) for r in found["node"].collect()) == sorted((i, round(a, 7), round(b, 7), t) for i, a, b, t in nodes)
    assert sorted((r["id"], r["refs"], [tuple(t) for t in r["tags"]]) for r in found["way"].collect()) == sorted(ways) and found["relation"].count() == 0
