"""Levels of detail."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNK_AREA_M2, CHUNKS_AT_FIRST_LOD, DENSE_BUILDINGS, LOD_DISTANCES_M, LOD_TOLERANCES_M, ROAD_CLASS, ROAD_LAST_LOD


def total_chunks(area_m2: float) -> int:
    return math.ceil(max(area_m2 / CHUNK_AREA_M2, 1.0))


def lod_count(chunks: int) -> int:
    return max(math.ceil(math.log2(chunks / CHUNKS_AT_FIRST_LOD)) + 1, 2)


@dataclass(frozen=True)
class Lod:
    """One level and the thresholds that follow from its tolerance, in single precision where that is their type."""

    lod: int
    distance_m: float
    tolerance_m: float

    @classmethod
    def levels(cls, count: int) -> list[Lod]:
        last = len(LOD_TOLERANCES_M) - 1
        return [cls(i, float(np.float32(LOD_DISTANCES_M[min(i, last)])), float(np.float32(LOD_TOLERANCES_M[min(i, last)]))) for i in range(count)]

    @property
    def epsilon(self) -> float:
        return float(np.float32(self.tolerance_m) * np.float32(self.tolerance_m))

    def _least(self, factor: int) -> float:
        t = np.float32(max(self.tolerance_m, 1.0))
        return float(t * t) * factor

    @property
    def min_area_box(self) -> float:
        return self._least(4) if self.lod else 0.0

    @property
    def min_building_box(self) -> float:
        return self._least(6) if self.lod else 8.0

    @property
    def min_road_diagonal(self) -> float:
        return float(np.float32(self.tolerance_m) * np.float32(2)) if self.lod else 0.0

    @property
    def snap_m(self) -> float:
        return min(max(self.tolerance_m, 1.0), 32.0) if self.lod >= 2 else 0.0

    @property
    def bucket_m(self) -> float:
        return min(max(max(self.snap_m, 1.0) * 12.0, 32.0), 128.0)

    @property
    def dense(self) -> int | None:
        return DENSE_BUILDINGS[min(self.lod, max(DENSE_BUILDINGS))] if self.lod >= 2 else None

    def row(self) -> tuple:
        return (self.lod, self.distance_m, self.tolerance_m, self.epsilon, self.min_area_box, self.min_building_box, self.min_road_diagonal, self.snap_m, self.bucket_m, self.dense)


LOD_ROW = "lod int, distance_m double, tolerance_m double, epsilon double, min_area_box double, min_building_box double, min_road_diagonal double, snap_m double, bucket_m double, dense int"


def lod_table(spark: SparkSession, count: int) -> DataFrame:
    """One row per level; a few dozen rows at most, since their number is a logarithm of the area."""
    return spark.createDataFrame([lod.row() for lod in Lod.levels(count)], LOD_ROW)


def lod_for_radius(radius: Column, distances: list[float]) -> Column:
    """The first level whose distance reaches the view radius, else the last."""
    return F.coalesce(*(F.when(radius <= d, F.lit(i)) for i, d in enumerate(distances)), F.lit(max(len(distances) - 1, 0)))


def road_visible(road_class: Column, lod: Column) -> Column:
    limits = [F.when(road_class == ROAD_CLASS[name], lod <= last) for name, last in ROAD_LAST_LOD.items() if last is not None]
    return F.coalesce(*limits, road_class.isNotNull())


def road_width(width_m: Column, lod: Column) -> Column:
    """Single precision at each step, as the stored type demands; never below one metre."""
    shrink = (F.lit(1.0).cast("float") + (lod.cast("float") * F.lit(0.12).cast("float")).cast("float")).cast("float")
    return F.greatest((width_m.cast("float") / shrink).cast("float"), F.lit(1.0).cast("float"))


def poi_visible(kind: Column, lod: Column) -> Column:
    return (lod < 4) | kind.startswith("place:") | (kind == "railway:station")
