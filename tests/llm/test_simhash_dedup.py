import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from tilespark.llm import simhash_dedup as S
from tilespark.llm.graph import connected_components

from .conftest import DOCS, awkward_rows, prose


def by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c d", "A b C d e\tf  g", "ünï Ä ß e f g h " * 5, "x" * 1000])
def test_fingerprint(text):
    assert S.fingerprint(text) == by_hand(text)


def test_native_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('alpha beta gamma delta')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"alpha beta gamma delta", 42)


@pytest.mark.parametrize("part_rows", [40, 1000])
def test_links_against_brute_force(spark, part_rows):
    rng = random.Random(12)
    points = {rng.getrandbits(64) for _ in range(300)}
    for center in [rng.getrandbits(64) for _ in range(20)]:
        for _ in range(rng.choice([1, 2, 8])):
            points.add(center)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                center ^= 1 << b
            points.add(center)
    dense = rng.getrandbits(64)  # a large ball
    points |= {dense ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)}
    points |= {0, 1, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(points)]
    frame = spark.createDataFrame([(fp, i) for i, fp in enumerate(signed)], "fp long, doc long").repartition(5)
    x = np.array(sorted(points), np.uint64)
    true = [(i, j) for i in range(len(x)) for j in range(i) if int(np.bitwise_count(x[i] ^ x[j])) <= 4]
    links = [tuple(r) for r in S.near_links(frame, part_rows=part_rows).collect()]
    assert set(map(frozenset, links)) <= set(map(frozenset, true))
    assert components(range(len(x)), links) == components(range(len(x)), true)
    assert len(true) > 2000


def test_tasks_get_few_points(spark, monkeypatch):
    """Also where all points come in one partition: each becomes 35 rows before they are counted."""
    rng, counted = random.Random(15), []
    points = [(rng.getrandbits(63), i) for i in range(1000)] + [(-1, 1000), (-2, 1001)]
    keep = S.shared_checkpoint

    def seen(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        counted.extend(int(n) for n in re.findall(r"hashpartitioning\(fp\S*, (\d+)\)|REPARTITION_BY_NUM", plan) if n)
        return keep(df)

    monkeypatch.setattr(S, "shared_checkpoint", seen)
    links = S.near_links(spark.createDataFrame(points, "fp long, doc long").coalesce(1), task_points=50)
    assert [set(r) for r in links.collect()] == [{1000, 1001}]
    assert S.spread(spark.createDataFrame(points, "fp long, doc long").coalesce(1), 50).rdd.getNumPartitions() == 21
    assert counted == [21]


def test_rows_of_shards_are_exchanged_once(spark, monkeypatch):
    """Whatever Spark supposes of the sizes; only if there are too many large shards for a broadcast, twice, with equal links."""
    rng = random.Random(16)
    dense = rng.getrandbits(62)
    points = [(rng.getrandbits(63), i) for i in range(500)] + [(dense ^ (1 << a) ^ (1 << b), 500 + 16 * a + b) for a in range(16) for b in range(a)]
    frame = spark.createDataFrame(points, "fp long, doc long").repartition(3)
    before, found = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in [(S.MOST_BROADCAST, "BroadcastHashJoin"), (0, "SortMergeJoin")]:
            monkeypatch.setattr(S, "MOST_BROADCAST", most)
            links = S.near_links(frame, part_rows=40)
            plan = links._jdf.queryExecution().sparkPlan().toString()
            assert {j for j in ("BroadcastHashJoin", "SortMergeJoin") if j in plan} == {join}
            found.append(components([d for _, d in points], [tuple(r) for r in links.collect()]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1] and len(set(found[0].values())) < 502


def test_any_four_bits_leave_a_key_equal():
    keys, rng = S.Keys(4), random.Random(2)
    assert len(keys.masks) == 35 and sum(keys.block_masks) == (1 << 64) - 1 and min(m.bit_count() for m in keys.masks) >= 27
    first = keys.first()
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        same = sum(1 << i for i, m in enumerate(keys.block_masks) if not differ & m)
        assert [k for k, m in enumerate(keys.masks) if not differ & m][0] == first[same]


def test_batches_may_end_anywhere():
    """Shards of two rows, of many, and tiles of a cut one, in batches of every size."""
    rng, keys = np.random.default_rng(8), S.Keys(4)
    center = rng.integers(0, 1 << 44, 40, dtype=np.int64)
    fp = np.unique(np.r_[center, center ^ 1 << 60, center[0] ^ np.arange(200) << 46])
    rows = pd.DataFrame({"choice": 0, "fp": fp, "doc": np.arange(len(fp)), "tile": 0, "shard": fp & keys.masks[0]})
    rows = rows.sort_values(["shard", "fp"], ignore_index=True).drop(columns="shard")
    whole = {tuple(r) for f in S._shards(keys)(iter([rows])) for r in f.to_numpy().tolist()}
    assert whole
    for size in (1, 7, 64):
        got = {tuple(r) for f in S._shards(keys)(rows.iloc[at : at + size] for at in range(0, len(rows), size)) for r in f.to_numpy().tolist()}
        assert components(range(len(fp)), got) == components(range(len(fp)), whole)


def test_tree_walk_equals_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    x[400:] = x[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    classes = S.Classes(len(x))
    S.search(x, np.arange(len(x)), None, 4, classes)
    true = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1)))]
    assert components(range(700), classes.links) == components(range(700), true)
    a, b = np.arange(400), np.arange(400, 700)
    across = S.Classes(len(x))
    S.search(x, a, b, 4, across)
    assert components(range(700), across.links) == components(range(700), [(i, j) for i, j in true if i < 400 <= j])


def test_documents(spark):
    rng = random.Random(13)
    docs = [(i, prose(rng, 80), "en", "s", 0) for i in range(40)]
    docs += [(100 + i, docs[i][1] if i % 2 else docs[i][1] + " tail", "en", "s", 0) for i in range(20)] + [(200, None, "en", "s", 0), (201, "", "en", "s", 0)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    fp = {d: by_hand(t) for d, t, *_ in docs}
    linked = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4]
    assert got == components(fp, linked) and got[201] == 200 and got[101] == 1


def test_query(spark):
    from tilespark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_simhash_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{by_hand(t):016x}" for i, t in texts.items()}
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(fp, linked)


def test_awkward(awkward, nothing):
    rows = S.near_duplicates(awkward).collect()
    assert len(rows) == len(awkward_rows()) and len({r["component_id"] for r in rows if r["doc_id"] in (30, 31, 32)}) == 1
    assert {r["component_id"] for r in rows if r["doc_id"] in (33, 34, 35)} == {33}
    assert S.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(14)
    chain = [(i, i + 1) for i in range(500, 560)]
    edges = chain + [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 7), (900, 5), (5, 900)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
