import random
import re

import numpy as np
import pytest

from tilespark.llm import mixing as M

from .conftest import DOCS, awkward_rows, prose


def targets_by_hand(sizes, budget=1.5, weights=(5, 2, 1), cap=2.0):
    """Share by weight, stop at the cap, share what is left again, until no source is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(10)
    sources = ["z", "a", None, "Ä", "b", "m"]
    return [(i, prose(rng, rng.choice([0, 3, 20, 90])), "en", rng.choice(sources + ["a"] * 6), 0) for i in range(900)]


def test_targets_and_rounding(spark, docs):
    frame = spark.createDataFrame(docs, DOCS)
    rows = M.mix_sources(frame.repartition(7), block_rows=20, fan=4).collect()
    again = M.mix_sources(frame.repartition(2), block_rows=20, fan=4).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, *_ in docs}
    by = {}
    for d, _, _, source, _ in docs:
        by[source] = by.get(source, 0) + size[d]
    hand = targets_by_hand(by)
    taken = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(hand[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        ratio = r["target"] / r["source_size"]
        assert r["copies"] in (int(ratio), int(ratio) + 1) or r["size"] == 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert sum(hand.values()) == pytest.approx(1.5 * sum(by.values()))
    assert all(abs(taken[s] - hand[s]) <= 45 + 1e-6 for s in hand)  # half of the longest document


def test_settling_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 200), rng.random(200) * 2
    total = np.zeros(200)
    for seed in range(300):
        q = M.settle(size, p, seed)
        assert (np.abs(q - np.rint(q)) > 1e-9).sum() <= 1 and (q * size).sum() == pytest.approx((p * size).sum())
        assert (q >= np.floor(p) - 1e-9).all() and (q <= np.floor(p) + 1 + 1e-9).all()
        total += q
    assert np.abs(total / 300 - p).max() < 0.15


def test_awkward(awkward, nothing):
    rows = M.mix_sources(awkward, block_rows=8).collect()
    assert len(rows) == len(awkward_rows()) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert M.mix_sources(nothing).count() == 0
    assert {r["taken"] for r in M.mix_sources(awkward.filter("doc_id IN (30, 31, 32)")).collect()} == {0}


def test_many_rows_alike_are_parted(spark):
    """One id and size for most rows: no block holds them all, and the target is met all the same."""
    docs = spark.createDataFrame([(7, "four words of text", "en", "a", 0)] * 900 + [(i, "some other words " * (i % 9 + 1), "en", "a", 0) for i in range(100)], DOCS).repartition(4)
    rows = M.mix_sources(docs, block_rows=64).collect()
    total = sum(r["size"] for r in rows)
    assert len(rows) == 1000 and abs(sum(r["taken"] for r in rows) - 1.5 * total) <= 27 and {r["copies"] for r in rows} <= {1, 2}
    sized = docs.selectExpr("doc_id", "source", "cast(size(split(text, ' ')) as long) AS size")
    parted = M.part_repeats(sized, 64)
    assert parted.filter("turn <> 0").select("turn").distinct().count() >= 899 and parted.count() == 1000
    assert M.part_repeats(sized, 1000).filter("turn <> 0").count() == 0
