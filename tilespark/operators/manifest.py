"""Counts and manifest rows of baked tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid

LAYERS = ("roads", "buildings", "areas", "pois")


def entity_counts(entities: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_id, roads, buildings, areas, pois) at level 0 for every row of ``tiles`` (tile_id); zero where there are none.
    ``entities``: tile_id, lod, layer."""
    counts = entities.filter("lod = 0").groupBy("tile_id").agg(*(F.count(F.when(F.col("layer") == n, 1)).alias(n) for n in LAYERS))
    return tiles.select("tile_id").join(counts, "tile_id", "left").select("tile_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in LAYERS))


def manifest_rows(counts: DataFrame, grid: Grid, sizes: DataFrame | None = None) -> DataFrame:
    """Manifest rows of counted tiles, by id. ``sizes``: tile_id, file_size_bytes."""
    x, y = grid.origin_of(F.col("tile_id"))
    rows = counts if sizes is None else counts.join(sizes, "tile_id", "left")
    size = F.lit(0).cast("bigint") if sizes is None else F.coalesce("file_size_bytes", F.lit(0).cast("bigint"))
    return rows.select(
        F.col("tile_id").alias("id"), (F.col("tile_id") % grid.cols).alias("grid_x"), F.floor(F.col("tile_id") / grid.cols).cast("bigint").alias("grid_y"),
        F.format_string("tile_%d", F.col("tile_id")).alias("file"), size.alias("file_size_bytes"), x.cast("double").alias("origin_x_m"), y.cast("double").alias("origin_y_m"),
        F.struct(*LAYERS).alias("entity_counts"),
    )


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id; all others stay."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def with_old_origin(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """``rows`` with the origin that ``previous`` has for their id, where it has one: a tile keeps the origin it was baked
    with, whatever the grid is now."""
    old = previous.select(F.col("id").alias("old_"), F.col("origin_x_m").alias("old_x_"), F.col("origin_y_m").alias("old_y_"))
    joined = rows.join(old, F.col("id") == F.col("old_"), "left")
    return joined.withColumns({"origin_x_m": F.coalesce("old_x_", "origin_x_m"), "origin_y_m": F.coalesce("old_y_", "origin_y_m")}).select(rows.columns)


def recover_manifest(specs: DataFrame, on_disk: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of the tiles found on disk, else of the previous manifest; tiles known to neither have none."""
    disk, before = on_disk.select("id", F.struct(*on_disk.columns).alias("disk")), previous.select("id", F.struct(*previous.columns).alias("before"))
    rows = specs.select(F.col("tile_id").alias("id")).join(disk, "id", "left").join(before, "id", "left")
    return rows.withColumn("row", F.coalesce("disk", "before")).filter(F.col("row").isNotNull()).select("row.*")
