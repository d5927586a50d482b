import numpy as np
import pytest

from tilespark.llm import embedding_dedup as E

ROW = "vec_id long, embedding array<float>, label int, vec string, n long"


def brute(rows, threshold=0.93):
    ok = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    component = {}
    for i in sorted(links, key=lambda i: rows[i][0]):
        if i not in component:
            front = [i]
            while front:
                j = front.pop()
                if j not in component:
                    component[j] = rows[i][0]
                    front += links[j]
    return sorted((rows[i][0], len(links[i]), component[i], rows[i][0] == component[i]) for i in links)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(150):
        out.append([len(out), rng.normal(size=16), i % 3])
        for _ in range([0, 0, 1, 0, 3][i % 5]):
            out.append([len(out), out[-1][1] + rng.normal(size=16) * 0.08, i % 3])
    seed = rng.normal(size=16)
    out += [[len(out) + j, seed + rng.normal(size=16) * 0.05, 1] for j in range(60)]  # more links than a list holds
    out += [[len(out) + j, out[0][1], 0] for j in range(5)]
    rows = [(i, [float(x) for x in v], label, "clash", 1) for i, v, label in out]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None] * 8, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [float("inf")] * 16, 1), (n + 7, rows[0][1][:8], 0), (n + 8, rows[0][1], 0)]
    return rows + [(i, v, label, "clash", 1) for i, v, label in odd]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, ROW).repartition(4)
    got = sorted(map(tuple, E.near_duplicates(docs, k=6).collect()))
    assert got == brute(rows)


def points_of(spark, rows, leaf_rows=64):
    return E.sized(E.usable(spark.createDataFrame(rows, ROW), "vec_id", "embedding", "label")[0], leaf_rows)


def test_audit_measures_recall(spark, rows):
    points = points_of(spark, rows)
    picked = E.sample(points, 10_000)
    assert len(picked) == points.count()
    true = E.true_links(points, picked, 0.93).join(points.select("u", "cls"), "u")
    nothing, none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "u long")
    assert E.missed(true, nothing, none, 0.95) and not E.missed(true, true, none, 0.95) and not E.missed(true, nothing, points, 0.95)


def test_planted_partners_are_evidence_without_any_link(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), 0, "clash", 1) for i in range(600)]
    points = points_of(spark, rows, 8)
    picked = E.sample(points, 256)
    assert 150 < len(picked) < 400
    assert not E.missed_planted(picked, 1, 0.93, 0.99, 0.95, 5) and E.missed_planted(picked, 1, 0.93, 0.3, 0.95, 5)


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_trees_bring_pairs_together(bits):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    depth, met = np.full(len(x), bits), np.zeros(len(x), bool)
    for t in range(E.trees_for(bits, 0.93, 0.99)):
        met |= E.leaf_codes(x, depth, t, 5) == E.leaf_codes(y, depth, t, 5)
    assert met.mean() > 0.975


def test_empty(spark, rows):
    assert E.near_duplicates(spark.createDataFrame([], ROW)).count() == 0
    assert E.near_duplicates(spark.createDataFrame(rows[-9:-1], ROW)).count() == 8


def test_links_across_dense_groups(spark):
    """Two balls whose members have all their nearest in their own ball, with links across."""
    rng, n = np.random.default_rng(9), 40
    centers = np.zeros((2, 64))
    centers[:, 0], centers[0, 1], centers[1, 1] = 1, 0.17, -0.17
    rows = [(2 * i + c, [float(x) for x in centers[c] + rng.normal(size=64) * 0.004], 0, "clash", 1) for c in (0, 1) for i in range(n)]
    for part_rows in (16, 512):
        got = sorted(map(tuple, E.near_duplicates(spark.createDataFrame(rows, ROW), k=5, part_rows=part_rows).collect()))
        assert got == brute(sorted(rows)) and sum(r[3] for r in got) == 1


def test_exact_where_the_target_is_not_met(spark, rows):
    """With a target that no audit can meet every link is found, however poor the lists are."""
    got = E.near_duplicates(spark.createDataFrame(rows, ROW), k=1, rounds=0, most_tries=1, leaf_rows=1, together=0.01, target=1.1)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_further_trees_where_the_audit_fails(spark, rows):
    """Too few trees at first: the planted partners show it, and later attempts add others."""
    got = sorted(map(tuple, E.near_duplicates(spark.createDataFrame(rows, ROW), leaf_rows=4, together=0.6).collect()))
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)


def test_depth_follows_each_label(spark):
    points = E.sized(spark.createDataFrame([(i, "1", [float(i + 1)]) for i in range(4000)] + [(9000 + i, "2", [1.0]) for i in range(100)] + [(1, "2", [1.0, 2.0])], "u long, label string, vec array<float>"), 64)
    assert {(r["label"], len(r["vec"])): r["bits"] for r in points.collect()} == {("1", 1): 6, ("2", 1): 1, ("2", 2): 0}
    assert points.select("space").distinct().count() == 3


def test_odd_ids(spark):
    """Null ids, an id with two vectors, and a vector with null ids only."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(None, a, 0, "", 1), (5, a, 0, "", 1), (5, b, 0, "", 1), (3, b, 0, "", 1), (None, c, 0, "", 1), (None, c, 0, "", 1)]
    got = E.near_duplicates(spark.createDataFrame(rows, ROW)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 1, 5, False), (5, 1, 5, True), (5, 1, 3, False), (3, 1, 3, True), (None, 1, None, True), (None, 1, None, True)]))


def test_doubles_stay_doubles(spark):
    def partner(cos):
        return [cos, (1 - cos * cos) ** 0.5, 0.0]

    rows = [(1, [1.0, 0.0, 0.0], 0), (2, partner(0.93 + 1e-9), 0), (3, [0.0, 0.0, 1.0], 1), (4, [(1 - (0.93 - 1e-9) ** 2) ** 0.5, 0.0, 0.93 - 1e-9], 1), (5, [1e200, 0.0], 2), (6, [2e200, 0.0], 2)]
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}
