"""Operator 5: near-duplicate vectors by NN-descent.

Equal vectors of a label count once, with a multiplicity. Every vector keeps a list of its nearest known neighbours among
the vectors of its label. The lists start from random-hyperplane trees, as deep as the label is large, and as many as it
takes for any pair at the threshold to share a leaf of one of them with probability ``together``. Then they are refined in
rounds: around each vector its neighbours are compared with one another. Links at or above the threshold are kept apart
from the lists, and where a list cannot hold all links of a block, a forest of them is kept as well, so a full list never
parts what is linked. Vectors whose lists are full of links get longer lists and other trees; where these are full again,
the whole component is compared, and its pairs are counted, not stored.

An audit compares sampled vectors of each size class of labels with all others of their label, and plants a partner exactly
at the threshold beside each sampled vector, so there is evidence also where links are rare. Classes that miss the target
get further trees; one that still misses it is compared whole. Cosines are in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, small_batches
from .graph import connected_components

MOST_BITS = 24


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of length one in double precision."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def trees_for(bits: int, threshold: float, together: float) -> int:
    """How many trees of this depth bring a pair at the threshold together: a random hyperplane spares it with probability
    1 - angle / pi."""
    spared = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if spared >= together else math.ceil(math.log(1 - together) / math.log(1 - spared))


def leaf_codes(x: np.ndarray, bits: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The leaf of each row of ``x`` in a tree of as many planes as ``bits`` says."""
    planes = np.random.default_rng((seed, tree, x.shape[1])).normal(size=(MOST_BITS, x.shape[1])).T
    most = max(1, int(bits.max()))
    return (((x @ planes[:, :most]) > 0) @ (1 << np.arange(most))) & ((1 << bits) - 1)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the row it was reached from, or -1: links enough to join whatever the matrix joins."""
    parent, todo = np.full(len(linked), -1), linked.any(axis=1)
    for root in range(len(linked)):
        front, todo[root] = [root] * int(todo[root]), False
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & todo)
            todo[new], parent[new] = False, i
            front.extend(new.tolist())
    return parent


def pairs_of(rows: pd.DataFrame, k: int, reach: float, threshold: float) -> pd.DataFrame:
    """(u, v, s, listed) of a block: up to ``k`` nearest of each row with a cosine of ``reach`` or more, and a forest of the
    links where a row has more. Rows of both sides are compared across only."""
    u, x = rows["u"].to_numpy(), matrix(rows["vec"])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    side = rows["tile"].to_numpy() & 1 if "tile" in rows else None
    if side is not None and side.any():
        s[side[:, None] == side[None, :]] = -2
    close = s >= reach
    some = np.flatnonzero(close.any(1))
    if not len(some):
        return pd.DataFrame({"u": u[:0], "v": u[:0], "s": s[0, :0], "listed": close[0, :0]})
    width = min(k, s.shape[1] - 1)
    near = np.argpartition(-s[some], width - 1, axis=1)[:, :width]
    i, j = np.repeat(some, width), near.ravel()
    good = close[i, j]
    i, j, listed = i[good], j[good], np.ones(good.sum(), bool)
    linked = s >= threshold
    if (linked.sum(1) > k).any():
        parent = forest(linked)
        child = np.flatnonzero(parent >= 0)
        i, j = np.r_[i, child, parent[child]], np.r_[j, parent[child], child]
        listed = np.r_[listed, np.zeros(2 * len(child), bool)]
    return pd.DataFrame({"u": u[i], "v": u[j], "s": s[i, j], "listed": listed})


PAIRS = "u long, v long, s double, listed boolean"


def by_run(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]):
    """Calls ``work`` on every run of equal keys in sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def parts(rows: pd.DataFrame, stop: int, cuts: list[int]) -> Iterator[pd.DataFrame]:
            for s, t in zip(cuts[:stop], cuts[1 : stop + 1]):
                if t - s > 1:
                    yield work(rows.iloc[s:t])

        for rows in batches:
            if not len(rows):
                continue
            key = rows[keys].to_numpy()
            if held and (key[-1] == held[0][keys].to_numpy()[0]).all():
                held.append(rows)  # still the same run
                continue
            rows = pd.concat((*held, rows), ignore_index=True)
            key = rows[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(rows)]
            yield from parts(rows, len(cuts) - 2, cuts)
            held = [rows.iloc[cuts[-2] :]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield from parts(rows, 1, [0, len(rows)])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(u, least, label, vec, n), distinct vectors with a number of their own, the smallest id and how many rows have them;
    and all rows as (vec_id, label, vec). Left out of the former: null labels, null, empty and zero vectors and those with
    components that are null or not finite. Floats stay floats, any other numbers become doubles."""
    vec = F.col(vector_col)
    if dict(rows.dtypes)[vector_col] != "array<float>":
        vec = vec.cast("array<double>")
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    clean = every.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
    return clean.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("u", F.monotonically_increasing_id()), every


def sized(points: DataFrame, leaf_rows: int) -> DataFrame:
    """``points`` with their space (equal labels, equal numbers of components; named after its smallest u), the depth of its
    trees and its size class."""
    points = shared_checkpoint(points)
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / leaf_rows)))).cast("long")
    cls = F.floor(F.log2("size") / 2).cast("long")  # sizes within a factor of four
    sizes = points.groupBy(F.col("label").alias("label_"), F.size("vec").alias("dims_")).agg(F.count(F.lit(1)).alias("size"), F.min("u").alias("space"))
    sizes = sizes.select("label_", "dims_", "space", bits.alias("bits"), cls.alias("cls"))
    joined = points.join(sizes, (F.col("label") == F.col("label_")) & (F.size("vec") == F.col("dims_")))
    return shared_checkpoint(joined.drop("label_", "dims_"))


def tiles(rows: DataFrame, keys: list[str], part_rows: int) -> DataFrame:
    """``rows`` with ``tile``: groups of ``keys`` larger than ``part_rows`` are cut into parts, and part p meets part q in a
    tile whose last bit is the side, 0 for the smaller one. Smaller groups are one tile."""
    own = [f"{k}_" for k in keys]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > part_rows)
    large = shared_checkpoint(large.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.ceil(F.col("m") / part_rows).alias("parts")))
    if large.isEmpty():
        return rows.withColumns({"tile": F.lit(0).cast("long"), "pair": F.lit(0).cast("long")}).repartition(*keys).sortWithinPartitions(*keys, "u")
    on = [F.col(k) == F.col(o) for k, o in zip(keys, own)]
    dealt = rows.join(large, on, "left").drop(*own).withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("u", *keys), F.col("parts")))
    tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: (
        (F.least(F.col("part"), q) * F.col("parts") + F.greatest(F.col("part"), q)) * 2 + (F.col("part") > q).cast("long")))
    rows = dealt.withColumn("tile", F.explode(tile)).drop("part", "parts")
    rows = rows.withColumn("pair", F.shiftright("tile", 1))
    return rows.repartition(*keys, "pair").sortWithinPartitions(*keys, "pair", "u")


def plant(points: DataFrame, *, attempt: int, k: int, threshold: float, reach: float, together: float, part_rows: int, seed: int) -> DataFrame:
    """Pairs (u, v, s, listed) from the leaves of random-hyperplane trees, other ones at each attempt."""
    many = np.array([trees_for(b, threshold, together) for b in range(MOST_BITS + 1)])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, part in rows.groupby(rows["vec"].map(len)):
                x, bits = matrix(part["vec"]), part["bits"].to_numpy()
                own = many[bits]
                codes = np.zeros((len(part), own.max(initial=0)), np.int64)
                for t in range(codes.shape[1]):
                    here, tree = own > t, attempt * 4096 + t
                    codes[here, t] = leaf_codes(x[here], bits[here], tree, seed) + (tree << 32)
                yield part.drop(columns="bits").assign(leaves=[c[:n] for c, n in zip(codes, own)])

    schema = f"u long, space long, vec {dict(points.dtypes)['vec']}, leaves array<long>"
    rows = points.select("u", "space", "vec", "bits").mapInPandas(leaves, schema).select("u", "space", "vec", F.explode("leaves").alias("leaf"))
    rows = tiles(rows, ["space", "leaf"], part_rows)
    return rows.mapInPandas(by_run(["space", "leaf", "pair"], lambda r: pairs_of(r, k, reach, threshold)), PAIRS)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct listed neighbours of each vector."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False), 1, k)
    return found.filter("listed").groupBy("u").agg(best.alias("list")).select("u", F.explode("list").alias("x")).select("u", "x.v", "x.s")


def refine(lists: DataFrame, points: DataFrame, k: int, reach: float, threshold: float) -> DataFrame:
    """One round: pairs among each vector and its neighbours, which are no more than its list holds."""
    around = lists.select(F.col("u").alias("center"), F.col("v").alias("u")).unionByName(lists.select(F.col("u").alias("center"), "u").distinct())
    rows = around.join(points.select("u", "vec"), "u").repartition("center").sortWithinPartitions("center", "u")
    return rows.mapInPandas(by_run(["center"], lambda r: pairs_of(r, k, reach, threshold)), PAIRS)


# ---------------------------------------------------------------- audit


def sample(points: DataFrame, queries: int) -> list:
    """About ``queries`` rows of each size class, by a hash of the vector's place; all of a class that has fewer."""
    totals = {r["cls"]: r["m"] for r in points.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).collect()}  # a class for each factor of four
    some = F.lit(False)
    for cls, total in totals.items():
        below = min(1 << 30, math.ceil((1 << 30) * queries / total))
        some |= (F.col("cls") == cls) & (F.pmod(F.xxhash64("label", "vec"), F.lit(1 << 30)) < below)
    return points.filter(some).select("u", "space", "cls", "bits", "vec").collect()


def true_links(points: DataFrame, picked: list, threshold: float) -> DataFrame:
    """All links (u, v) of the ``picked`` rows, each compared with its whole space."""
    ids, spaces = np.array([r["u"] for r in picked]), np.array([r["space"] for r in picked])
    vectors = {space: matrix(pd.Series([picked[i]["vec"] for i in np.flatnonzero(spaces == space)])) for space in set(spaces.tolist())}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for space, part in rows.groupby("space"):
                if space in vectors:
                    i, j = np.nonzero(vectors[space] @ matrix(part["vec"]).T >= threshold)
                    a, b = ids[spaces == space][i], part["u"].to_numpy()[j]
                    yield pd.DataFrame({"u": a[a != b], "v": b[a != b]})

    return points.select("u", "space", "vec").mapInPandas(count, "u long, v long")


def missed_planted(picked: list, attempts: int, threshold: float, together: float, target: float, seed: int) -> set[int]:
    """The size classes in which partners planted exactly at the threshold beside the sampled vectors share a leaf too
    rarely."""
    rng, found = np.random.default_rng((seed, attempts)), {}
    by_shape: dict[tuple[int, int, int], list] = {}
    for r in picked:
        by_shape.setdefault((r["cls"], r["bits"], len(r["vec"])), []).append(r["vec"])
    for (cls, bits, dims), vectors in by_shape.items():
        x = matrix(pd.Series(vectors))
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away
        met, depth = np.zeros(len(x), bool), np.full(len(x), bits)
        for attempt in range(attempts):
            for t in range(trees_for(bits, threshold, together)):
                met |= leaf_codes(x, depth, attempt * 4096 + t, seed) == leaf_codes(y, depth, attempt * 4096 + t, seed)
        hits, total = found.get(cls, (0, 0))
        found[cls] = hits + met.sum(), total + len(met)
    return {cls for cls, (hits, total) in found.items() if hits < target * total}


def shares(true: DataFrame, links: DataFrame) -> DataFrame:
    """(u, share): how many of the true links of each u are among ``links`` (u, v)."""
    return true.join(links.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left").groupBy("u").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))


def missed(true: DataFrame, links: DataFrame, full: DataFrame, target: float) -> set[int]:
    """The size classes of ``true`` (u, v, cls) whose recall is below the target. Links of ``full``, whose components are
    compared whole in the end, count as found."""
    seen = true.join(full.select("u"), "u", "left_semi").select("u", "v")
    recall = shares(true.select("u", "v"), links.select("u", "v").unionByName(seen).distinct()).join(true.select("u", "cls").distinct(), "u").groupBy("cls").agg(F.avg("share").alias("r"))
    return {r["cls"] for r in recall.filter(F.col("r") < target).collect()}


# ---------------------------------------------------------------- whole groups


def exact_links(points: DataFrame, members: DataFrame, threshold: float, part_rows: int) -> DataFrame:
    """(u, links, v): every two vectors of a group of ``members`` (u, group) are compared, in tiles of bounded size. The sum
    of links over a u's rows, weighed by multiplicity, is exact. Pairs are counted, not kept; of them v, null or a linked
    vector, joins what the pairs join."""
    rows = tiles(members.join(points.select("u", "n", "vec"), "u"), ["group"], part_rows)

    def work(r: pd.DataFrame) -> pd.DataFrame:
        u, n, x, side = r["u"].to_numpy(), r["n"].to_numpy(), matrix(r["vec"]), r["tile"].to_numpy() & 1
        linked = (x @ x.T) >= threshold
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        linked |= linked.T
        parent = forest(linked)
        out = pd.DataFrame({"u": u, "links": linked @ n, "v": pd.array(np.where(parent < 0, 0, u[parent]), dtype="Int64")})
        out.loc[parent < 0, "v"] = pd.NA
        return out[out["links"] > 0]

    return rows.mapInPandas(by_run(["group", "pair"], work), "u long, links long, v long")


def near_duplicates(
    rows: DataFrame, *, threshold: float = 0.93, k: int = 10, rounds: int = 2, together: float = 0.99, target: float = 0.95, audits: int = 256, most_tries: int = 4,
    leaf_rows: int = 256, part_rows: int = 512, widen: float = 1.5, settled: float = 0.001, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows``, whatever other columns it has.

    Vectors compare only within equal labels and equal numbers of components. Null labels and vectors that are null, zero
    or hold null or non-finite components have no links and are their own component. Repeated rows count each: a row links
    with every other row of an equal vector. Rows of one id with different vectors are different vectors, each with its own
    links. A null id counts as larger than any other; component_id is null where all ids are, and kept compares nulls as
    equal. An empty table gives an empty table.

    Lists hold neighbours within ``widen`` times the angle of the threshold. ``together`` is the chance that the trees of
    one attempt bring a pair at the threshold together, ``target`` the recall that the audit demands. Rounds end early when
    one adds no more than the share ``settled`` of pairs.
    """
    small_batches(rows.sparkSession)
    points, every = usable(rows, id_col, vector_col, label_col)
    points = sized(points, leaf_rows)
    reach = math.cos(min(math.pi / 2, widen * math.acos(max(-1.0, min(1.0, threshold)))))
    picked = sample(points, audits)
    true = shared_checkpoint(true_links(points, picked, threshold).join(points.select("u", "cls"), "u")) if picked else None
    found, todo, failing, full = None, points, set(), None
    for attempt in range(most_tries):
        size = k << attempt
        grown = plant(todo, attempt=attempt, k=size, threshold=threshold, reach=reach, together=together, part_rows=part_rows, seed=seed)
        found = shared_checkpoint(grown if found is None else grown.unionByName(found))
        for _ in range(rounds):
            more = refine(nearest(found, size), todo, size, reach, threshold)
            before, found = found, shared_checkpoint(found.unionByName(more).groupBy("u", "v").agg(F.max("s").alias("s"), F.max("listed").alias("listed")))
            if found.count() <= (1 + settled) * before.select("u", "v").distinct().count():
                break
        near = found.filter(F.col("s") >= threshold)
        links = shared_checkpoint(near.select("u", "v").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        # only a vector with as many links as its list holds can have lost some
        full = shared_checkpoint(links.groupBy("u").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= size).select("u"))
        failing = missed_planted(picked, attempt + 1, threshold, together, target, seed) | (missed(true, links, full, target) if picked else set())
        if not failing and (attempt or full.isEmpty()):
            break
        around = full.unionByName(links.join(full, "u").select(F.col("v").alias("u"))).distinct()
        again = F.col("cls").isin(list(failing)) if failing else F.lit(False)
        todo = shared_checkpoint(points.join(around.withColumn("around_", F.lit(True)), "u", "left").filter(again | F.col("around_")).select(points.columns))
    named = shared_checkpoint(connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    # full lists are compared with all of their component, classes that miss the target after all are compared whole
    dense = full.join(named, F.col("u") == F.col("node")).select("component").distinct()
    members = named.join(dense, "component", "left_semi").select(F.col("node").alias("u"), (F.col("component") * 2 + 1).alias("group"))
    if failing:
        whole = points.filter(F.col("cls").isin(list(failing))).select("u", (F.col("space") * 2).alias("group"))
        members = members.join(whole.select("u"), "u", "left_anti").unionByName(whole)
    members = shared_checkpoint(members)
    exact = shared_checkpoint(exact_links(points, members, threshold, part_rows))
    if failing:  # else all that is found within a component was joined before
        joins = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(exact.filter("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")))
        named = shared_checkpoint(connected_components(joins))
    # links of members are counted above, all within their group; those of others come from the lists
    sparse = links.join(members.select("u"), "u", "left_anti").join(points.select(F.col("u").alias("v"), "n"), "v").select("u", F.col("n").alias("links"))
    counted = exact.select("u", "links").unionByName(sparse).groupBy("u").agg(F.sum("links").alias("links"))
    summary = points.select("u", "least", "label", "vec", "n").join(counted, "u", "left").join(named.withColumnRenamed("node", "u"), "u", "left")
    summary = shared_checkpoint(summary.select("label", "vec", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "u").alias("component")))
    ids = shared_checkpoint(summary.groupBy(F.col("component").alias("c_")).agg(F.min("least").alias("component_id")))
    key = F.xxhash64("label", "vec")
    summary = summary.join(ids, F.col("component") == F.col("c_")).select(F.col("label").alias("label_"), F.col("vec").alias("vec_"), key.alias("key_"), "n_links", "component_id", F.lit(True).alias("linked_"))
    joined = every.withColumn("key", key).join(shared_checkpoint(summary), (F.col("key") == F.col("key_")) & (F.col("label") == F.col("label_")) & (F.col("vec") == F.col("vec_")), "left")
    component = F.when(F.col("linked_"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
