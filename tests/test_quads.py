"""Kernels over many shapes at once against the same over single ones."""

import numpy as np

from tilespark.functions import geometry as G


def test_quads_at_once_equal_one_by_one():
    rng = np.random.default_rng(21)
    n = 3000
    x0, y0 = rng.uniform(-500, 500, (2, n))
    w, h = rng.choice([0.0, 0.3, 2.0, 7.0, 20.0, 60.0], (2, n)) * rng.uniform(0.5, 1.5, (2, n))
    x, y = np.stack((x0, x0 + w, x0 + w, x0, x0), 1), np.stack((y0, y0, y0 + h, y0 + h, y0), 1)
    bent = rng.random(n) < 0.4
    x[bent, 2] += rng.uniform(-20, 20, bent.sum())
    y[bent, 1] += rng.uniform(-20, 20, bent.sum())
    x[:3, 1], y[3:6, 4] = np.nan, 1e6
    lod = rng.integers(0, 5, n)
    epsilon, snap = np.array([0.0025, 0.04, 1, 25, 400])[lod], np.array([0, 0, 1.0, 5.0, 20.0])[lod]
    layer = rng.choice(np.array(["building", "area", "road"], object), n, p=[0.8, 0.1, 0.1])
    done, null, points, qx, qy = G.simplify_quads(x, y, layer, lod, epsilon, snap)
    for i in np.flatnonzero(done).tolist():
        want = G.simplify_shape(list(zip(x[i].tolist(), y[i].tolist())), layer[i], int(lod[i]), float(epsilon[i]), float(snap[i]))
        assert want == (None if null[i] else list(zip(qx[i, : points[i]].tolist(), qy[i, : points[i]].tolist()))), i
    assert done.sum() > n // 3 and 50 < null[done].sum() < done.sum() and (points[done] == 4).sum() > 50


def test_what_a_rectangle_covers_adds_nothing(monkeypatch):
    rng, merged = np.random.default_rng(22), []
    keep = G._merge_all
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    rings = [box(*map(float, (*rng.integers(0, 60, 2), *rng.integers(1, 20, 2)))) for _ in range(150)]
    rings += [[(x, y), (x + 9, y + 1), (x + 2, y + 7), (x, y)] for x, y in rng.integers(0, 80, (40, 2)).astype(float).tolist()] + [box(20.0, 20.0, 30.0, 30.0)] * 3
    monkeypatch.setattr(G, "_merge_all", lambda regions: merged.append(len(regions)) or keep(regions))
    canon = lambda out: sorted(tuple(r[:-1][(k := r.index(min(r[:-1]))) :] + r[:-1][:k]) for r in out)
    fast = canon(G.union_rings(rings, 1.0))
    assert max(merged) < 150  # of 191 different ones
    monkeypatch.setattr(G, "_uncovered", list)
    assert canon(G.union_rings(rings, 1.0)) == fast
