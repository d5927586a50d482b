"""The tile grid: row-major tiles from the south-west corner."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .project import mercator_point, mercator_x, mercator_y


@dataclass(frozen=True)
class Grid:
    origin_x: float
    origin_y: float
    size: int
    cols: int
    rows: int

    @classmethod
    def from_bounds(cls, min_x: float, min_y: float, max_x: float, max_y: float, size: int) -> Grid:
        """The smallest grid of whole tiles over the bounds; at least one tile."""
        if size <= 0:
            raise ValueError("the tile size must be above zero")
        ox, oy = math.floor(min_x / size) * size, math.floor(min_y / size) * size
        return cls(float(ox), float(oy), size, max(math.ceil((max_x - ox) / size), 1), max(math.ceil((max_y - oy) / size), 1))

    @classmethod
    def from_lat_lon(cls, min_lat: float, min_lon: float, max_lat: float, max_lon: float, size: int) -> Grid:
        return cls.from_bounds(*mercator_point(min_lat, min_lon), *mercator_point(max_lat, max_lon), size)

    @property
    def count(self) -> int:
        return self.cols * self.rows

    def specs(self, spark: SparkSession) -> DataFrame:
        """(tile_id, grid_x, grid_y, min_x, min_y, max_x, max_y) of every tile; nothing is built on the driver."""
        gx, gy = F.col("id") % self.cols, F.floor(F.col("id") / self.cols)
        x, y = F.lit(self.origin_x) + gx * self.size, F.lit(self.origin_y) + gy * self.size
        return spark.range(self.count).select(
            F.col("id").alias("tile_id"), gx.alias("grid_x"), gy.cast("bigint").alias("grid_y"),
            x.alias("min_x"), y.alias("min_y"), (x + self.size).alias("max_x"), (y + self.size).alias("max_y"),
        )

    def column_of(self, x: Column) -> Column:
        return F.floor((x - self.origin_x) / self.size).cast("bigint")

    def row_of(self, y: Column) -> Column:
        return F.floor((y - self.origin_y) / self.size).cast("bigint")

    def origin_of(self, tile_id: Column) -> tuple[Column, Column]:
        return F.lit(self.origin_x) + (tile_id % self.cols) * self.size, F.lit(self.origin_y) + F.floor(tile_id / self.cols) * self.size

    def ids_in(self, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        """Array of the tile ids of a range of columns and rows; empty where a range runs backwards."""
        cols = F.sequence(x0, x1)
        ids = F.flatten(F.transform(F.sequence(y0, y1), lambda r: F.transform(cols, lambda c: r * self.cols + c)))
        return F.when((x0 <= x1) & (y0 <= y1), ids).otherwise(F.array().cast("array<bigint>"))

    def ids_for_box(self, xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
        """Ids of the tiles under a box whose corners may be swapped. Clamped into the grid, so never empty."""
        clamp = lambda v, n: F.greatest(F.least(v, F.lit(n - 1).cast("bigint")), F.lit(0).cast("bigint"))
        return self.ids_in(
            clamp(self.column_of(F.least(xa, xb)), self.cols), clamp(self.column_of(F.greatest(xa, xb)), self.cols),
            clamp(self.row_of(F.least(ya, yb)), self.rows), clamp(self.row_of(F.greatest(ya, yb)), self.rows),
        )

    def ids_for_lat_lon_box(self, min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
        return self.ids_for_box(mercator_x(min_lon), mercator_y(min_lat), mercator_x(max_lon), mercator_y(max_lat))

    def visible_ids(self, x: Column, y: Column, scale: Column, width: float = 1280.0, height: float = 720.0, preload: int = 1) -> Column:
        """Ids of the tiles in view and ``preload`` around; empty outside the grid."""
        hw, hh = scale * max(width, 1.0) * 0.5, scale * max(height, 1.0) * 0.5
        low = lambda v: F.greatest(v - preload, F.lit(0).cast("bigint"))
        high = lambda v, n: F.least(v + preload, F.lit(n - 1).cast("bigint"))
        return self.ids_in(low(self.column_of(x - hw)), high(self.column_of(x + hw), self.cols), low(self.row_of(y - hh)), high(self.row_of(y + hh), self.rows))


def tile_ids_of_ranges(text: Column, max_id: int) -> Column:
    """Sorted distinct ids of a list such as "1, 3-5,4". Blanks are skipped; an empty text selects nothing; what is no
    number, ends before it starts or lies above ``max_id`` is an error."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def ids(part: Column) -> Column:
        start, end = F.trim(F.split_part(part, F.lit("-"), F.lit(1))), F.trim(F.when(part.contains("-"), F.substring_index(part, "-", -1)).otherwise(part))
        a, b = start.try_cast("bigint"), end.try_cast("bigint")
        wrong = a.isNull() | b.isNull() | (a > b) | (b > max_id)
        return F.when(wrong, F.raise_error(F.concat(F.lit("not a tile id or range: "), part)).cast("array<bigint>")).otherwise(F.sequence(a, F.greatest(a, b)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, ids))))


def parse_tile_ids(text: str, max_id: int) -> list[int]:
    """The same for one text on the driver."""
    ids: set[int] = set()
    for part in filter(None, map(str.strip, text.split(","))):
        start, dash, end = part.partition("-")
        a, b = int(start), int(end if dash else start)
        if a > b or b > max_id:
            raise ValueError(f"not a tile id or range: {part}")
        ids.update(range(a, b + 1))
    return sorted(ids)
