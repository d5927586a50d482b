"""Operator 7: mix sources to target weights by pivotal dependent rounding.

Every document gets a fractional copy probability ``target(source) / size(source)``. Inside blocks of one source the
fractional parts are paired: mass (probability times words) moves between the two documents in a random direction,
chosen so that expectations stay, until one of them is integral. The one left over from each block goes up a reduction
tree of the blocks, level by level, until one document of the source is fractional; it is rounded to the nearer side.
The words taken from a source therefore miss its target by at most half of one document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared_checkpoint

ROW = "doc_id long, source string, size long, source_size long, target double, p double, block long, done boolean"


def source_targets(sized: DataFrame, budget: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row per source: (source, source_size, n_docs, target).

    The shares are filled like water: a source stops at ``cap`` times its size and what it leaves goes to the others by
    weight. With sources sorted by cap / weight, the level is that of the first source which stays below its cap.
    The windows run over one row per source, never over documents.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    one = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        one.withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .select("source", "source_size", "n_docs", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))
    )


def settle(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Pairwise rounding of the fractional parts; at most one entry of the result is fractional."""
    p, rng = p.copy(), np.random.default_rng(seed)
    draws, active = rng.random(len(p)), -1
    for j in range(len(p)):
        frac = p[j] - np.floor(p[j])
        if frac < 1e-9 or frac > 1 - 1e-9 or size[j] == 0:
            p[j] = np.rint(p[j])
            continue
        if active < 0:
            active = j
            continue
        i, low_i, low_j = active, np.floor(p[active]), np.floor(p[j])
        fi, fj, si, sj = p[i] - low_i, frac, float(size[i]), float(size[j])
        up, down = min((1 - fi) * si, fj * sj), min(fi * si, (1 - fj) * sj)
        if draws[j] * (up + down) < down:
            fi, fj = fi + up / si, fj - up / sj
        else:
            fi, fj = fi - down / si, fj + down / sj
        p[i], p[j] = low_i + fi, low_j + fj
        over = [k for k, f in ((i, fi), (j, fj)) if 1e-9 < f < 1 - 1e-9]
        for k in (i, j):
            if k not in over:
                p[k] = np.rint(p[k])
        active = over[0] if over else -1
    return p


def _level(seed: int, fan: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
        p = settle(rows["size"].to_numpy(), rows["p"].to_numpy(), zlib.crc32(f"{seed}|{key[0]!r}|{key[1]}".encode()))
        return rows.assign(p=p, done=np.abs(p - np.rint(p)) < 1e-9, block=rows["block"] // fan)

    return run


def part_repeats(sized: DataFrame, block_rows: int) -> DataFrame:
    """``sized`` with ``turn``: 0, but for rows of an id and size that stand more than ``block_rows`` times in a source, which
    one block could not hold: those are numbered apart by their place in the checkpoint."""
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("source", "doc_id", "size")]
    many = sized.groupBy(*(F.col(c).alias(f"{c}_") for c in ("source", "doc_id", "size"))).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block_rows)
    many = shared_checkpoint(many.drop("m").withColumn("many", F.lit(True)))
    if many.isEmpty():
        return sized.withColumn("turn", F.lit(0).cast("long"))
    placed = sized.withColumn("turn", F.monotonically_increasing_id()).join(many, same[0] & same[1] & same[2], "left")
    return placed.select("doc_id", "source", "size", F.when(F.col("many"), F.col("turn")).otherwise(0).alias("turn"))


def mix_sources(
    docs: DataFrame, *, budget: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: float = 2.0, seed: int = 7,
    block_rows: int = 1024, fan: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per row of ``docs``.

    Null texts have size 0; documents of size 0 are rounded without moving mass. A null source is a source of its own,
    ranked last. Repeated rows are rounded separately. An empty table gives an empty result. Other columns are not looked
    at, whatever their names. Draws depend on the seed, the source and the block of a document only, so reruns agree; of
    rows that repeat more than ``block_rows`` times, on how Spark splits the input as well.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = shared_checkpoint(sized)  # three small columns: the texts are read once
    targets = source_targets(sized, budget, weights, cap)
    sized = part_repeats(sized, block_rows)
    blocks = F.ceil(F.col("n_docs") / block_rows)
    spread: Column = F.pmod(F.xxhash64("doc_id", "size", "turn", F.lit(seed)), blocks).cast("long")
    key = targets.withColumnRenamed("source", "source_")
    rows = sized.join(key, sized["source"].eqNullSafe(key["source_"]), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("p"),
        spread.alias("block"), F.lit(False).alias("done"),
    )
    largest = targets.agg(F.max(blocks)).first()[0] or 1
    settled, level = None, 0
    while True:
        rows = shared_checkpoint(rows.groupBy("source", "block").applyInPandas(_level(seed + level, fan), ROW))
        last = largest <= 1
        part = rows if last else rows.filter("done")
        settled = part if settled is None else settled.unionByName(part)
        if last:
            break
        rows, largest, level = rows.filter("not done"), -(-largest // fan), level + 1
    copies = F.rint("p").cast("long")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
