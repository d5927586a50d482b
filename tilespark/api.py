"""The public interface."""

from .functions.geometry import register as register_functions
from .functions.grid import Grid, parse_tile_ids
from .operators.tiling import assign_tiles, selected_tiles
from .plans.bake import bake, bake_layers, extract_features, nested_tiles, scan_bounds
from .sources.osm import read_osm_pbf, read_osm_xml
from .sources.tiles import read_index, read_layer
from .streaming.viewport import load_evict, load_evict_stream, viewer_start, with_view

__all__ = [
    "Grid", "assign_tiles", "bake", "bake_layers", "extract_features", "load_evict", "load_evict_stream", "nested_tiles", "parse_tile_ids", "read_index",
    "read_layer", "read_osm_pbf", "read_osm_xml", "register_functions", "scan_bounds", "selected_tiles", "viewer_start", "with_view",
]
