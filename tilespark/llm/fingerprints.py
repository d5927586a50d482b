"""Operator 1: bottom-k sketches of word shingles, by DataFrame functions alone.

The sketch of a text holds the k smallest distinct 64-bit hashes of its shingles (five words, A-Z lower-cased; a text of
fewer words is one shingle; one without words has none). The sketch of a union is the k smallest of two sketches together,
so parts can be merged in any order. Sketches estimate resemblance, containment and the number of distinct shingles; below
k shingles all three are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, lower_ascii, shuffle_partitions, split_words

SHINGLE = 5
K = 256


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the k smallest distinct shingle hashes; null counts as empty."""
    hashes = F.transform(split_words(lower_ascii(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))
    nothing = F.array().cast("array<bigint>")

    def shingles(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
        return F.when(F.size(h) == 0, nothing).when(F.size(h) < shingle, F.array(F.xxhash64(h))).otherwise(windows)

    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity, 0 to 1; two empty sets are alike. Exact where neither sketch is full."""
    union = F.when((F.size(a) < k) & (F.size(b) < k), F.array_union(a, b)).otherwise(merge(a, b, k))
    return let(union, lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the set behind ``a`` that lies in the one behind ``b``, 0 to 1; an empty set lies in any."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def merge_groups(rows: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group: the ``k`` smallest of its distinct hashes. The limit by rank is applied before the
    exchange too, so a task sees no more than ``k`` hashes of a group from each other task, however large the group is. A
    group of empty or null sketches has an empty one."""
    hashes = rows.select(*keys, F.explode_outer(column).alias("hash_")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("hash_").asc_nulls_last()))
    least = hashes.withColumn("rank_", rank).filter(F.col("rank_") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash_")).alias(column))


def to_hex(a: Column) -> Column:
    """16 upper-case digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are not below the value; two short searches instead of one long one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*(F.lit(v).cast("bigint") for v in values))
    count = lambda array: F.size(F.filter(array, lambda b: b >= value))
    tops = F.array(*(F.lit(p[-1]).cast("bigint") for p in parts))
    rest = F.array(*map(longs, parts), F.array().cast("array<bigint>"))
    return F.when(value.isNull(), len(bounds)).otherwise(let(count(tops), lambda g: F.least(g * step, F.lit(len(bounds))) + count(F.element_at(rest, g + 1))))


def with_next(docs: DataFrame, columns: dict[str, Column], *, buckets_per_partition: int = 3) -> DataFrame:
    """Adds next_NAME for each column: its value in the next row by descending doc_id (nulls last, ties by text), after
    the last row that of the first.

    Rows are dealt to ranges of the id whose bounds are approximate quantiles, that is, ids that occur. The first row of
    each range goes to the range before as well, so that no range needs to look into another; only the bounds reach the
    driver. ``columns`` are computed after the shuffle, once for each row.
    """
    n = shuffle_partitions(docs.sparkSession) * buckets_per_partition
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("q"), F.max("doc_id").alias("top")).first()
    bounds = sorted(set(found["q"] or []), reverse=True)
    own = _bucket(F.col("doc_id"), bounds)
    copy = lambda bucket, order: F.struct(bucket.cast("int").alias("bucket"), F.lit(order).alias("order"))
    places = let(own, lambda b: F.array_compact(F.array(
        copy(b, 0),
        F.when(F.col("doc_id").isin(bounds) if bounds else F.lit(False), copy(b - 1, 1)),
        F.when(F.col("doc_id").eqNullSafe(F.lit(found["top"])), copy(F.lit(len(bounds)), 2)),
    )))
    dealt = docs.withColumn("place_", F.explode(places)).withColumn("bucket_", F.col("place_.bucket")).withColumn("order_", F.col("place_.order")).drop("place_").repartition("bucket_")
    order = Window.partitionBy("bucket_").orderBy("order_", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.withColumns(columns)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("order_ = 0").drop("bucket_", "order_")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles).

    The edited text ends in the beginning of the next document in place of its own last third. Null texts count as empty.
    Equal ids are ordered by text, equal rows follow each other; a lone document is its own next. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"text": F.col("text"), "sketch": sketch(F.col("text"), k)})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", cut)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substring(F.col("next_text"), F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_hex(F.col("sketch")).alias("fingerprint"), to_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
    )
