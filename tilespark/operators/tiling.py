"""Which tiles a feature belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..schema import TILE_MARGIN

#: Room for rounding at boxes that touch exactly; the predicate after it is exact.
SLACK = 1e-6


def assign_tiles(features: DataFrame, grid: Grid, tiles: DataFrame | None = None) -> DataFrame:
    """Every row with min_x, min_y, max_x, max_y once for each tile that it meets, as tile_id.

    A tile reaches 1 % of its width beyond each side; boxes that touch meet. The tiles under a box are enumerated and
    exploded, so there is neither a theta join nor an index; features are never clipped. ``tiles`` (tile_id) restricts
    the result by an equi-join.
    """
    def cover(low: Column, high: Column, origin: float, n: int) -> tuple[Column, Column]:
        first = F.ceil((low - origin) / grid.size - (1 + TILE_MARGIN) - SLACK).cast("bigint")
        last = F.floor((high - origin) / grid.size + TILE_MARGIN + SLACK).cast("bigint")
        return F.greatest(first, F.lit(0).cast("bigint")), F.least(last, F.lit(n - 1).cast("bigint"))

    x0, x1 = cover(F.col("min_x"), F.col("max_x"), grid.origin_x, grid.cols)
    y0, y1 = cover(F.col("min_y"), F.col("max_y"), grid.origin_y, grid.rows)
    out = features.withColumn("tile_id", F.explode(grid.ids_in(x0, x1, y0, y1)))
    left, bottom = grid.origin_of(F.col("tile_id"))
    margin = grid.size * TILE_MARGIN
    out = out.filter((F.col("min_x") <= left + grid.size + margin) & (F.col("max_x") >= left - margin) & (F.col("min_y") <= bottom + grid.size + margin) & (F.col("max_y") >= bottom - margin))
    return out if tiles is None else out.join(tiles.select("tile_id"), "tile_id", "left_semi")


def selected_tiles(grid: Grid, spark, tile_ids: list[int] | None = None, lat_lon_box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(tile_id ...) of the specs chosen: by ids, else by a box (min_lat, min_lon, max_lat, max_lon), else all."""
    specs = grid.specs(spark)
    if tile_ids is not None:
        return specs.join(spark.createDataFrame([(i,) for i in sorted(set(tile_ids))], "tile_id bigint"), "tile_id", "left_semi")
    if lat_lon_box is not None:
        ids = spark.range(1).select(F.explode(grid.ids_for_lat_lon_box(*(F.lit(float(v)) for v in lat_lon_box))).alias("tile_id"))
        return specs.join(ids, "tile_id", "left_semi")
    return specs
