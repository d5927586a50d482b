"""From references to geometry: relation members, rings and node positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import outer_members
from ..functions.geometry import stitch_udf


def member_segments(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel_id, segments, places): the refs of the outer member ways, in member order and with repeats, and each one's place
    among all members, from zero; ways that are absent or have fewer than two refs are skipped. ``relations``: id, members.
    ``ways``: id, refs."""
    placed = F.transform("members", lambda m, i: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"), i.alias("place")))
    members = relations.select(F.col("id").alias("rel_id"), F.explode(outer_members(placed)).alias("m")).select("rel_id", F.col("m.place").alias("place"), F.col("m.ref").alias("way_id"))
    usable = ways.filter(F.size("refs") >= 2).select(F.col("id").alias("way_id"), "refs")
    found = members.join(usable, "way_id").groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("place", "refs"))).alias("s"))
    return found.select("rel_id", F.transform("s", lambda s: s["refs"]).alias("segments"), F.transform("s", lambda s: s["place"]).alias("places"))


def stitched_rings(segments: DataFrame) -> DataFrame:
    """(rel_id, ring_no, refs): one row per closed ring."""
    return segments.select("rel_id", F.posexplode(stitch_udf("segments")).alias("ring_no", "refs"))


def kernel_partitions(spark: SparkSession) -> int:
    """Partitions for work by geometry kernels, which is heavy for few bytes: Spark keeps a number that is given, while it
    would put small partitions of its own together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


#: Words of the bitmap of needed nodes, whatever their number.
NEEDED_WORDS = 1 << 18


def needed_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """The ``nodes`` that some row of ``refs`` (node_id) may need, by a broadcast bitmap of fixed size over hashes of the
    ids; a few others pass too, more as the bitmap fills, and the join that follows is exact. What does not pass is never
    exchanged."""
    spread = lambda c: F.xxhash64(F.col(c).cast("bigint"))
    word = lambda c: F.pmod(spread(c), F.lit(NEEDED_WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(cast({c} as bigint)), 20) & 63 as int))")
    bitmap = refs.groupBy(word("node_id").alias("word_")).agg(F.bit_or(bit("node_id")).alias("bits_"))
    met = nodes.join(F.broadcast(bitmap), word("id") == F.col("word_"))
    return met.filter(F.col("bits_").bitwiseAND(bit("id")) != 0).drop("word_", "bits_")


def resolve_points(features: DataFrame, nodes: DataFrame, key: str, least: int) -> DataFrame:
    """(key, xs, ys): positions of the refs in their order. A feature with an unknown node, or with fewer than ``least``
    points, is dropped whole. ``features``: key, refs. ``nodes``: id, x, y."""
    refs = features.select(key, F.posexplode("refs").alias("pos", "node_id"))
    found = refs.join(needed_nodes(nodes, refs).select(F.col("id").alias("node_id"), "x", "y"), "node_id", "left")
    found = found.repartition(kernel_partitions(features.sparkSession), key)
    points = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("points"))
    return points.filter((F.col("n") == F.col("known")) & (F.col("n") >= least)).select(key, F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys"))


def point_arrays(points: DataFrame, key: str) -> DataFrame:
    """(key, xs, ys) of rows (key, pos, x, y)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    points = points.repartition(kernel_partitions(points.sparkSession), key)
    return points.groupBy(key).agg(ordered.alias("p")).select(key, F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))


def with_envelope(shapes: DataFrame) -> DataFrame:
    """Adds min_x, min_y, max_x, max_y of the arrays xs and ys."""
    return shapes.withColumns({"min_x": F.array_min("xs"), "min_y": F.array_min("ys"), "max_x": F.array_max("xs"), "max_y": F.array_max("ys")})
