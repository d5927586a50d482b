"""Types, codes and fixed values of the map model."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
QPOINT = "struct<x:int,y:int>"
QBOUNDS = "struct<min_x:int,min_y:int,max_x:int,max_y:int>"
TAGS = "array<struct<k:string,v:string>>"

OSM_NODE = f"id bigint, lat double, lon double, tags {TAGS}"
OSM_WAY = f"id bigint, refs array<bigint>, tags {TAGS}"
OSM_RELATION = f"id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags {TAGS}"

AREA_ROW = f"tile_id bigint, lod int, kind int, bounds {QBOUNDS}, rings array<array<{QPOINT}>>"
BUILDING_ROW = f"tile_id bigint, lod int, bounds {QBOUNDS}, footprint array<{QPOINT}>"
ROAD_ROW = f"tile_id bigint, lod int, class int, width_m float, bounds {QBOUNDS}, points array<{QPOINT}>"
POI_ROW = f"tile_id bigint, lod int, kind string, name string, point {QPOINT}"

ENTITY_COUNTS = "struct<roads:bigint,buildings:bigint,areas:bigint,pois:bigint>"
TILE_MANIFEST = f"struct<id:bigint,grid_x:bigint,grid_y:bigint,file:string,file_size_bytes:bigint,origin_x_m:double,origin_y_m:double,entity_counts:{ENTITY_COUNTS}>"
MAP_INDEX = (
    "version int, region string, source_pbf string, total_chunks_estimate bigint, total_tile_count bigint, lod_count int, "
    "lod_viewing_distances_m array<float>, lod_simplification_tolerances_m array<float>, quantization_scale float, "
    "tile_grid struct<origin_x_m:double,origin_y_m:double,tile_size_m:bigint,cols:bigint,rows:bigint>, "
    "world_bounds_mercator struct<min_x:double,min_y:double,max_x:double,max_y:double>, "
    "world_bounds_lat_lon struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, "
    f"tiles array<{TILE_MANIFEST}>"
)

# ---- fixed values: they must equal those of the format that the tiles are read and written for

EARTH_RADIUS_M = 6378137.0
MAX_LATITUDE = 85.05112878
QUANTIZATION_SCALE = 100.0
TILE_MARGIN = 0.01
CHUNK_AREA_M2 = 1_000_000.0
CHUNKS_AT_FIRST_LOD = 1000.0

#: name -> code
TERRAIN = {"Unknown": 0, "Water": 1, "Grass": 2, "Forest": 3, "Urban": 4, "Farmland": 5, "Sand": 6, "Road": 7}
#: the higher one wins where several tags match
TERRAIN_PRIORITY = {"Unknown": 0, "Grass": 1, "Farmland": 2, "Forest": 3, "Sand": 4, "Urban": 5, "Water": 6, "Road": 7}
#: terrain -> key -> values; "*" stands for any value
TERRAIN_TAGS = {
    "Water": {"natural": ["water", "wetland", "bay", "coastline"], "waterway": ["riverbank"], "landuse": ["reservoir"], "leisure": ["swimming_area"]},
    "Forest": {"landuse": ["forest", "wood"], "natural": ["wood", "heath", "scrub", "tree_row"]},
    "Urban": {
        "landuse": ["residential", "commercial", "industrial", "retail", "construction", "brownfield", "depot", "Dhaka Woasa", "education", "garages", "landfill", "military", "religious", "slam", "slum", "yes"],
        "building": ["*"], "amenity": ["*"], "office": ["*"],
        "leisure": ["bleachers", "fitness_station", "outdoor_seating", "resort", "slipway", "sports_centre", "stadium", "swimming_pool"],
    },
    "Farmland": {"landuse": ["farmland", "allotments", "farmyard", "orchard", "vineyard", "greenhouse_horticulture", "plant_nursery", "plantation"]},
    "Sand": {"natural": ["sand", "beach"]},
    "Grass": {
        "landuse": ["grass", "meadow", "village_green", "recreation_ground", "cemetery", "churchyard", "common", "flowerbed", "greenfield", "open space", "open_space", "playground"],
        "leisure": ["common", "garden", "golf_course", "open space", "Open space", "park", "pitch", "playground", "practice_pitch", "track"],
        "natural": ["grassland", "yes"],
    },
}

ROAD_CLASS = {"Motorway": 0, "Primary": 1, "Secondary": 2, "Local": 3, "Service": 4, "Track": 5}
ROAD_HIGHWAYS = {
    "Motorway": ["motorway", "trunk", "motorway_link", "trunk_link"], "Primary": ["primary", "primary_link"],
    "Secondary": ["secondary", "secondary_link", "tertiary", "tertiary_link"], "Local": ["residential", "unclassified", "living_street", "road", "busway"],
    "Service": ["service"], "Track": ["track"],
}
ROAD_WIDTH_M = {"Motorway": 14.0, "Primary": 11.0, "Secondary": 8.5, "Local": 7.0, "Service": 6.0, "Track": 5.0}
#: the last level at which a class shows; None: all
ROAD_LAST_LOD = {"Motorway": None, "Primary": None, "Secondary": 5, "Local": 3, "Service": 2, "Track": 1}

LOD_DISTANCES_M = [50.0, 200.0, 1000.0, 5000.0, 20000.0, 100000.0, 500000.0]
LOD_TOLERANCES_M = [0.05, 0.2, 1.0, 5.0, 20.0, 100.0, 500.0]
#: buildings in a bucket from which on they are merged, from level 2 up
DENSE_BUILDINGS = {2: 12, 3: 10, 4: 8, 5: 6, 6: 4}
PLACES = ["city", "town", "village"]

MOVE_SPEED, ZOOM_LERP, ZOOM_WHEEL, PRELOAD_TILES, VIEW_WIDTH_M, FIT_PADDING = 900.0, 8.0, 0.25, 1, 800.0, 1.08

#: red, green and blue in hundredths
TERRAIN_COLOR = {
    "Unknown": (18, 18, 20), "Water": (10, 32, 68), "Grass": (27, 53, 23), "Forest": (7, 34, 16), "Urban": (47, 43, 40), "Farmland": (60, 54, 22), "Sand": (80, 75, 52), "Road": (16, 16, 17),
}
ROAD_COLOR = {"Motorway": (75, 29, 18), "Primary": (82, 47, 18), "Secondary": (90, 73, 35), "Local": (18, 18, 19), "Service": (30, 30, 33), "Track": (47, 42, 28)}
BUILDING_COLOR, POI_COLOR, POI_RADIUS = (69, 63, 57), (92, 16, 16), 18.0
