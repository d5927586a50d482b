"""Dense buildings merge into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import shape_points, union_rings, valid_ring
from .resolve import kernel_partitions

KEYS = ["tile_id", "lod", "bucket_x", "bucket_y"]
OUT = ["tile_id", "lod", "xs", "ys"]


def with_bucket(buildings: DataFrame, counted: bool = True) -> DataFrame:
    """Adds bucket_x and bucket_y, from the centre of the box, and on demand the number of buildings of the bucket."""
    bucket = lambda a, b: F.floor((F.col(a) + F.col(b)) * 0.5 / F.col("bucket_m")).cast("bigint")
    rows = buildings.withColumns({"bucket_x": bucket("box_x0", "box_x1"), "bucket_y": bucket("box_y0", "box_y1")})
    return rows if not counted else rows.withColumn("bucket_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))


def merged(group: pd.DataFrame) -> list[tuple]:
    """Outer rings of the union of a bucket's buildings, but those that are too small for the level."""
    first, kept = group.iloc[0], []
    distinct = {(x.tobytes(), y.tobytes()): (x, y) for x, y in zip(map(np.asarray, group["xs"]), map(np.asarray, group["ys"]))}
    for ring in union_rings([shape_points(x, y) for x, y in distinct.values()], float(first["snap_m"])):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        if valid_ring(ring) and (max(xs) - min(xs)) * (max(ys) - min(ys)) >= first["min_building_box"]:
            kept.append((first["tile_id"], first["lod"], xs, ys))
    return kept


def merge_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by KEYS: buckets with at least ``dense`` rows merge, all others pass as they are. A bucket may begin in
    one batch and end in another."""
    held: list[pd.DataFrame] = []

    def done(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        out, alone = [], []
        for s, t in zip(cuts[:-1], cuts[1:]):
            dense = rows["dense"].iloc[s]
            if pd.notna(dense) and t - s >= dense:
                out += merged(rows.iloc[s:t])
            else:
                alone.append(rows.iloc[s:t][OUT])
        return pd.concat([*alone, pd.DataFrame(out, columns=OUT)], ignore_index=True)

    for rows in batches:
        if not len(rows):
            continue
        key = rows[KEYS].to_numpy()
        if held and (key[-1] == held[0][KEYS].to_numpy()[0]).all():
            held.append(rows)
            continue
        rows = pd.concat((*held, rows), ignore_index=True)
        key = rows[KEYS].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
        if len(cuts) > 1:
            yield done(rows, cuts)
        held = [rows.iloc[cuts[-1] :]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield done(rows, [0, len(rows)])


def dissolve_dense(buildings: DataFrame) -> DataFrame:
    """(tile_id, lod, xs, ys): buildings of a tile, where those of a bucket with at least ``dense`` of them are merged.

    The buildings are read and exchanged once, whether they merge or not. A bucket is at most 128 m wide, which bounds what
    one group holds. Below level 2 nothing merges.
    """
    rows = with_bucket(buildings, counted=False).select(*KEYS, "xs", "ys", "snap_m", "min_building_box", "dense")
    return rows.repartition(kernel_partitions(rows.sparkSession), *KEYS).sortWithinPartitions(*KEYS).mapInPandas(merge_buckets, "tile_id bigint, lod int, xs array<double>, ys array<double>")
