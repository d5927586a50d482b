"""Properties of the kernels and of the tile cover."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.functions.geometry import drop_repeats, ring_area, simplify_preserve, snap_ring, stitch_rings, union_rings, valid_ring
from tilespark.functions.grid import Grid
from tilespark.operators.tiling import assign_tiles
from tilespark.sources.osm import _encode, packed

point = st.tuples(st.integers(0, 40).map(float), st.integers(0, 40).map(float))
few = settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(point, min_size=2, max_size=30), st.floats(0, 50))
def test_simplified_lines_keep_ends_and_order(points, epsilon):
    points = drop_repeats(points)
    out = simplify_preserve(points, epsilon, False)
    assert out[0] == points[0] and out[-1] == points[-1] and len(out) >= min(2, len(points))
    rest = iter(points)
    assert all(p in rest for p in out)


@few
@given(st.lists(point, min_size=3, max_size=12, unique=True), st.floats(0, 100))
def test_simplified_rings_stay_valid(points, epsilon):
    ring = [*points, points[0]]
    if valid_ring(ring):
        out = simplify_preserve(ring, epsilon, True)
        assert len(out) >= 4 and out[0] == out[-1] and set(out) <= set(ring)
        assert valid_ring(out) or abs(ring_area(out)) == 0


@few
@given(st.lists(point, min_size=3, max_size=8, unique=True), st.sampled_from([1.0, 2.5, 5.0]))
def test_snapping_twice_changes_nothing(points, grid):
    once = snap_ring([*points, points[0]], grid)
    if once is not None:
        assert snap_ring(once, grid) == once


@few
@given(st.lists(st.lists(point, min_size=3, max_size=5, unique=True), min_size=1, max_size=6))
def test_union_area_lies_between_the_largest_and_the_sum(shapes):
    rings = [r for r in ([*s, s[0]] for s in shapes) if valid_ring(r)]
    if rings:
        areas = [abs(ring_area(r)) for r in rings]
        total = sum(ring_area(r) for r in union_rings(rings, 1.0))
        # filled holes may add to the sum, never take from the largest
        assert total >= max(areas) - 1e-9
        box = (max(p[0] for r in rings for p in r) - min(p[0] for r in rings for p in r)) * (max(p[1] for r in rings for p in r) - min(p[1] for r in rings for p in r))
        assert total <= box + 1e-9


def inside(x, y, ring):
    return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:])) % 2 == 1


def flooded(open_cells, corners):
    """The open cells that are reached from outside the lattice."""
    front, seen = [(-1, -1)], {(-1, -1)}
    while front:
        x, y = front.pop()
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                cell = (x + dx, y + dy)
                if (corners or not dx or not dy) and cell not in seen and cell in open_cells:
                    seen.add(cell)
                    front.append(cell)
    return seen


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=10))
def test_union_of_boxes_cell_by_cell(boxes):
    """Axis-parallel buildings: the union covers their cells and the holes among them, and nothing else."""
    n = 18
    covered = {(x, y) for a, b, w, h in boxes for x in range(a, a + w) for y in range(b, b + h)}
    open_cells = {(x, y) for x in range(-1, n + 1) for y in range(-1, n + 1)} - covered
    outside = flooded(open_cells, False)
    if outside == flooded(open_cells, True):  # else parts meet in a corner only, and what is a hole depends on the reading
        rings = [[(a, b), (a + w, b), (a + w, b + h), (a, b + h), (a, b)] for a, b, w, h in boxes]
        got = union_rings([[(x * 2.0, y * 2.0) for x, y in r] for r in rings], 2.0)
        filled = {(x, y) for x in range(n) for y in range(n) if any(inside(2 * x + 1, 2 * y + 1, r) for r in got)}
        assert filled == {(x, y) for x in range(n) for y in range(n)} - outside
        assert sum(ring_area(r) for r in got) == 4 * len(filled)


@few
@given(st.lists(st.lists(point, min_size=3, max_size=5, unique=True), min_size=1, max_size=6))
def test_union_covers_what_the_rings_cover(shapes):
    rings = [r for r in ([*s, s[0]] for s in shapes) if valid_ring(r)]
    got = union_rings(rings, 1.0) if rings else []
    for x in range(0, 40, 3):
        for y in range(0, 40, 3):
            at = (x + 0.3719, y + 0.6133)
            assert not any(inside(*at, r) for r in rings) or any(inside(*at, r) for r in got)


@few
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=40), st.booleans())
def test_varints_all_at_once(values, zigzag):
    data = b"".join(_encode(1, [v])[2:] for v in values)
    assert packed(data, zigzag).tolist() == [(v >> 1) ^ -(v & 1) if zigzag else v for v in values]


@few
@given(st.lists(st.lists(st.integers(1, 9), min_size=2, max_size=5), max_size=6))
def test_stitched_rings_are_closed_and_made_of_member_edges(segments):
    edges = {frozenset(e) for s in segments for e in zip(s, s[1:])}
    for ring in stitch_rings(segments):
        assert ring[0] == ring[-1] and len(ring) >= 4 and all(frozenset(e) in edges for e in zip(ring, ring[1:]))


def test_tile_cover_equals_the_theta_join(spark):
    grid = Grid(1000.0, -500.0, 333, 7, 5)
    rows = [(i, 1000 + (i * 7919 % 2600) - 100.0, -500 + (i * 104729 % 1900) - 100.0, (i * 31 % 700) * 1.0, (i * 17 % 500) * 1.0) for i in range(800)]
    rows += [(900 + i, 1000 + 333 * i + 3.33, -500 + 333.0 * i - 3.33, 0.0, 0.0) for i in range(6)]
    boxes = spark.createDataFrame(rows, "id int, min_x double, min_y double, w double, h double").withColumns({"max_x": F.expr("min_x + w"), "max_y": F.expr("min_y + h")})
    got = {(r["id"], r["tile_id"]) for r in assign_tiles(boxes, grid).collect()}
    expected, m = set(), 333 * 0.01
    for i, x, y, w, h in rows:
        for t in range(grid.count):
            left, bottom = 1000.0 + t % 7 * 333, -500.0 + t // 7 * 333
            if x <= left + 333 + m and x + w >= left - m and y <= bottom + 333 + m and y + h >= bottom - m:
                expected.add((i, t))
    assert got == expected
