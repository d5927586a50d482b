"""Operator 10: near duplicates by SimHash fingerprints and vantage-point trees.

Sharding is by blocks of bits (banding), not by vantage points: fingerprints are nearly uniform, so trees that shard them by
distance must copy most points into both branches (the README has the figures). A fingerprint is cut into ``bits`` + 3
blocks; two that differ in at most ``bits`` bits agree on three of them at least. There is one set of shards for every
choice of three blocks, a shard being the fingerprints that agree on all three (27 bits or more for four differing bits),
so the copies of a fingerprint, 35, do not grow with the input, nor do shards need to look into one another.

Within a shard a vantage-point tree over the whole fingerprint finds the pairs: points are parted by their distance from a
vantage point at the median radius, a branch is pruned where the triangle bound excludes it, and what lies within ``bits``
of the boundary is searched on both sides. Shards of a few rows are compared directly, many at once. Shards that grow large
are cut into parts, and every pair of parts is searched, so no task gets a large group and no pair is missed. Only links
that join two classes of a shard leave it, and only from the first shard that holds both ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, small_batches
from .graph import connected_components

SEED = 42
SHINGLE = 4
LEAF = 96
#: Shards of up to so many rows are compared directly.
FEW = 32
#: So many large shards at most are broadcast (some 20 MB); for more of them the rows of all shards are exchanged.
MOST_BROADCAST = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set where over half the shingle hashes have it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :][:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


class Classes:
    """Union-find over positions; remembers the links that joined two classes."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def brute(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, bits: int, classes: Classes) -> None:
    """The links among the positions ``a``, or between ``a`` and ``b``, as far as they tell classes."""
    other = a if b is None else b
    if len(a) * len(other) <= LEAF * LEAF:
        i, j = np.nonzero(np.bitwise_count(x[a][:, None] ^ x[other][None, :]) <= bits)
        if len(i) <= 4 * (len(a) + len(other)):
            for p, q in zip(a[i].tolist(), other[j].tolist()):
                if p != q:
                    classes.join(p, q)
            return
    # breadth first: every point is compared once with the points not reached yet
    alive = [a, other]
    same = b is None
    while len(alive[0]) and len(alive[1]):
        front = [(int(alive[0][0]), 0)]
        alive[0] = alive[0][1:]
        if same:
            alive[1] = alive[0]
        while front:
            p, side = front.pop()
            to = alive[0] if same else alive[1 - side]
            hit = np.bitwise_count(x[to] ^ x[p]) <= bits
            if hit.any():
                for q in to[hit].tolist():
                    classes.join(p, q)
                    front.append((q, 1 - side))
                if same:
                    alive = [to[~hit]] * 2
                else:
                    alive[1 - side] = to[~hit]


def search(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, bits: int, classes: Classes) -> None:
    """Links among the positions ``a``, or between ``a`` and ``b``, by a vantage-point tree that is walked as it grows."""
    work = [(a, b)]
    while work:
        a, b = work.pop()
        if not len(a) or b is not None and not len(b):
            continue
        every = a if b is None else np.concatenate((a, b))
        if len(every) <= LEAF:
            brute(x, a, b, bits, classes)
            continue
        vantage = x[every[len(every) // 2]]
        da = np.bitwise_count(x[a] ^ vantage).astype(np.int16)
        db = da if b is None else np.bitwise_count(x[b] ^ vantage).astype(np.int16)
        radius = int(np.median(da if b is None else np.concatenate((da, db))))
        inner_a, outer_a = da <= radius, da > radius
        inner_b, outer_b = db <= radius, db > radius
        if outer_a.sum() + outer_b.sum() == 0 or inner_a.sum() + inner_b.sum() == 0 or np.ptp(np.concatenate((da, db))) <= bits:
            brute(x, a, b, bits, classes)  # the bound excludes nothing here
            continue
        if b is None:
            work += [(a[inner_a], None), (a[outer_a], None), (a[inner_a & (da > radius - bits)], a[outer_a & (da <= radius + bits)])]
        else:
            work += [(a[inner_a], b[inner_b]), (a[outer_a], b[outer_b])]
            work += [(a[inner_a & (da > radius - bits)], b[outer_b & (db <= radius + bits)]), (a[outer_a & (da <= radius + bits)], b[inner_b & (db > radius - bits)])]


@dataclass(frozen=True)
class Keys:
    """The choices of ``agree`` out of ``bits + agree`` blocks."""

    bits: int
    agree: int = 3

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.bits + self.agree), self.agree))

    @property
    def block_masks(self) -> list[int]:
        n = self.bits + self.agree
        edges = [64 * i // n for i in range(n + 1)]
        return [(1 << hi) - (1 << lo) for lo, hi in zip(edges[:-1], edges[1:])]

    @property
    def masks(self) -> list[int]:
        return [sum(self.block_masks[b] for b in choice) for choice in self.choices]

    def first(self) -> np.ndarray:
        """For each set of blocks, as bits, the first choice within it; -1 where there is none."""
        sets = [sum(1 << b for b in choice) for choice in self.choices]
        return np.array([next((i for i, s in enumerate(sets) if s & x == s), -1) for x in range(1 << (self.bits + self.agree))])


def _shards(keys: Keys):
    """Rows sorted by (choice, shard, tile) to the links of each; batches may end within a shard."""
    masks, blocks, first, bits = np.array(keys.masks, np.uint64), [np.uint64(m) for m in keys.block_masks], keys.first(), keys.bits

    def own(choice: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no earlier choice brings i and j together as well."""
        differ = x[i] ^ x[j]
        same = sum(((differ & m) == 0).astype(np.int64) << k for k, m in enumerate(blocks))
        return first[same] == choice[i]

    def links(choice: np.ndarray, x: np.ndarray, tile: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        ends = np.r_[starts[1:], len(x)]
        found = [np.zeros((0, 2), np.int64)]
        small = ends - starts <= FEW
        at = np.flatnonzero(np.repeat(small, ends - starts))
        end = np.repeat(ends, ends - starts)
        step = 1
        while len(at := at[at + step < end[at]]):
            near = at[np.bitwise_count(x[at] ^ x[at + step]) <= bits]
            found.append(np.stack((near, near + step), 1))
            step += 1
        for s, t in zip(starts[~small].tolist(), ends[~small].tolist()):
            classes, side = Classes(t - s), tile[s:t] & 1
            if side.any():
                search(x[s:t], np.flatnonzero(side == 0), np.flatnonzero(side == 1), bits, classes)
            else:
                search(x[s:t], np.arange(t - s), None, bits, classes)
            found.append(np.array(classes.links, np.int64).reshape(-1, 2) + s)
        i, j = np.concatenate(found).T
        kept = own(choice, x, i, j)
        return pd.DataFrame({"a": doc[i[kept]], "b": doc[j[kept]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for last, rows in chain(((False, rows) for rows in batches), [(True, None)]):
            rows = rest if rows is None else rows if rest is None else pd.concat((rest, rows), ignore_index=True)
            if rows is None or not len(rows):
                continue
            choice, x, tile = rows["choice"].to_numpy(), rows["fp"].to_numpy().astype(np.int64).view(np.uint64), rows["tile"].to_numpy()
            shard, pair = x & masks[choice], tile >> 1
            starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (shard[1:] != shard[:-1]) | (pair[1:] != pair[:-1])])
            stop = len(rows) if last else starts[-1]
            if stop:
                yield links(choice[:stop], x[:stop], tile[:stop], rows["doc"].to_numpy()[:stop], starts[starts < stop])
            rest = rows.iloc[stop:]

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": np.array([fingerprint(t) for t in rows["text"]], np.uint64).view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def spread(points: DataFrame, task_points: int) -> DataFrame:
    """``points`` in tasks of about ``task_points`` rows; Spark keeps a number of partitions that is given."""
    tasks = -(-points.count() // task_points)
    return points.repartition(max(tasks, points.sparkSession.sparkContext.defaultParallelism), "fp")


def near_links(points: DataFrame, *, bits: int = 4, part_rows: int = 1000, task_points: int = 20_000) -> DataFrame:
    """Links (a, b) that join the classes of ``points`` (fp distinct, doc).

    A point of a few bytes becomes a row for each of the 35 choices. AQE sees the bytes and would put half a million points
    into one task, whose counts of shards then take all memory there is; so tasks get ``task_points`` of them. The rows meet
    the large shards, known and few by then, by a broadcast: left to the sizes that Spark supposes, they may all be exchanged.
    """
    keys, points = Keys(bits), spread(points, task_points)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    shard = F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in keys.masks))
    shards = points.select("fp", "doc", F.posexplode(shard).alias("choice", "shard"))
    large = shards.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows).select("choice", "shard", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    large = shared_checkpoint(large)
    known = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    dealt = shards.join(known, ["choice", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # part p meets part q in the tile (min, max), whose last bit is the side: 0 for the smaller one
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: (
        (F.least(F.col("part"), q).cast("long") * F.col("parts") + F.greatest(F.col("part"), q)) * 2 + (F.col("part") > q).cast("long")))
    rows = dealt.withColumn("part", part).select("choice", "shard", "fp", "doc", F.explode(tiles).alias("tile"))
    pair = F.shiftright("tile", 1)
    rows = rows.repartition("choice", "shard", pair).sortWithinPartitions("choice", "shard", pair, "fp").drop("shard")
    return rows.mapInPandas(_shards(keys), "a long, b long")


def near_duplicates(docs: DataFrame, *, bits: int = 4, part_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest id reachable by links of at most ``bits`` bits.

    Null, empty and blank texts have the fingerprint zero. Rows with the same fingerprint are linked; repeated ids get equal
    components where their texts do. A null id stays, and stands for the largest number in its component.
    """
    known = shared_checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col))
    points = shared_checkpoint(known.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("doc")))
    joined = connected_components(near_links(points, bits=bits, part_rows=part_rows))
    named = shared_checkpoint(points.join(joined, F.col("doc") == F.col("node"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "doc").alias("component_id")))
    return known.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")
