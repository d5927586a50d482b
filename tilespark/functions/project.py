"""Scalar geometry: projection, quantization, bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_RADIUS_M, MAX_LATITUDE, QBOUNDS, QPOINT, QUANTIZATION_SCALE

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def mercator_x(lon: Column) -> Column:
    """Web Mercator metres; the longitude is neither clamped nor wrapped."""
    return F.radians(lon) * EARTH_RADIUS_M


def mercator_y(lat: Column) -> Column:
    clamped = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * EARTH_RADIUS_M


def mercator(lat: Column, lon: Column) -> Column:
    return F.struct(mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))


def mercator_point(lat: float, lon: float) -> tuple[float, float]:
    """The same on the driver."""
    lat = min(max(lat, -MAX_LATITUDE), MAX_LATITUDE)
    return math.radians(lon) * EARTH_RADIUS_M, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * EARTH_RADIUS_M


def round_away(v: Column) -> Column:
    """Nearest whole number as a double, halves away from zero."""
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def quantize(v: Column, origin: Column) -> Column:
    """Centimetres from the tile's origin as a double; see ``fits_int`` before casting."""
    return round_away((v - origin) * QUANTIZATION_SCALE)


def fits_int(v: Column) -> Column:
    """Whether a quantized value can be stored; not so for null, NaN and infinity."""
    return F.coalesce((v >= INT_MIN) & (v <= INT_MAX) & ~F.isnan(v), F.lit(False))


def to_int(v: Column) -> Column:
    """Saturating cast."""
    return F.greatest(F.least(v, F.lit(float(INT_MAX))), F.lit(float(INT_MIN))).cast("int")


def quantize_points(xs: Column, ys: Column, origin_x: Column, origin_y: Column) -> Column:
    """array<struct<x,y>> of quantized points; null if any point is out of range, which drops the feature."""
    points = F.arrays_zip(F.transform(xs, lambda v: quantize(v, origin_x)).alias("x"), F.transform(ys, lambda v: quantize(v, origin_y)).alias("y"))
    fine = F.forall(points, lambda p: fits_int(p["x"]) & fits_int(p["y"]))
    cast = F.transform(points, lambda p: F.struct(to_int(p["x"]).alias("x"), to_int(p["y"]).alias("y")))
    return F.when(fine & (F.size(points) > 0), cast).cast(f"array<{QPOINT}>")


def quantized_bounds(points: Column) -> Column:
    """struct<min_x,min_y,max_x,max_y>; null for no point."""
    end = lambda f, c: f(F.transform(points, lambda p: p[c]))
    box = F.struct(end(F.array_min, "x").alias("min_x"), end(F.array_min, "y").alias("min_y"), end(F.array_max, "x").alias("max_x"), end(F.array_max, "y").alias("max_y"))
    return F.when(F.size(points) > 0, box).cast(QBOUNDS)


def to_world(q: Column, origin: Column) -> Column:
    """Single-precision world coordinate of a quantized one."""
    return (origin + q.cast("double") / QUANTIZATION_SCALE).cast("float")


def snap(v: Column, grid: Column) -> Column:
    return round_away(v / grid) * grid


def box_area(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Area of a bounding box; sides below zero count as zero."""
    return F.greatest(max_x - min_x, F.lit(0.0)) * F.greatest(max_y - min_y, F.lit(0.0))


def box_diagonal(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.hypot(max_x - min_x, max_y - min_y)


def without_repeats(points: Column) -> Column:
    """Array without consecutive equal entries."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def centimetres(v: Column) -> Column:
    """Whole centimetres, halves up: a form in which doubles of two engines compare equal."""
    return F.floor(v * 100 + 0.5).cast("bigint")
