"""Kernels over single geometries, and the Arrow UDFs around them."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Point = tuple[float, float]


def stitch_rings(segments: list[list[int]]) -> list[list[int]]:
    """Closed rings of node ids from way segments.

    The last segment left is the seed. While a chain is open, the first segment whose head is the chain's tail follows, or
    whose last node is, reversed; the last segment left takes the place of the one used. A chain that finds none is given
    up; a closed one counts from four nodes up.
    """
    left, rings = [list(s) for s in segments if s], []
    while left:
        chain = left.pop()
        while chain[0] != chain[-1]:
            at = next((i for i, s in enumerate(left) if chain[-1] in (s[0], s[-1])), None)
            if at is None:
                break
            part = left[at]
            left[at] = left[-1]
            left.pop()
            chain += part[1:] if part[0] == chain[-1] else part[-2::-1]
        if chain[0] == chain[-1] and len(chain) >= 4:
            rings.append(chain)
    return rings


def drop_repeats(points: list[Point]) -> list[Point]:
    return [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]


def _side(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two closed segments share a point."""
    s1, s2, s3, s4 = _side(*a, *b, *c), _side(*a, *b, *d), _side(*c, *d, *a), _side(*c, *d, *b)
    if ((s1 > 0) != (s2 > 0) or s1 == 0 or s2 == 0) and ((s3 > 0) != (s4 > 0) or s3 == 0 or s4 == 0):
        return max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))
    return False


def _clash(points: list[Point], i: int, j: int, n: int) -> bool:
    """Whether the sides i and j of a ring share more than they may."""
    gap = (j - i) % n
    if gap in (1, n - 1):  # neighbours share a corner; folding back would share more
        a, b, c = (points[i], points[i + 1], points[(i + 2) % n]) if gap == 1 else (points[j], points[j + 1], points[(j + 2) % n])
        return _side(*a, *b, *c) == 0 and (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) < 0
    return segments_meet(points[i], points[i + 1], points[j], points[j + 1])


def valid_ring(points: list[Point]) -> bool:
    """Closed, finite, at least three distinct corners, area above zero, and no two sides that meet but at their corner."""
    if len(points) < 4 or points[0] != points[-1] or not all(math.isfinite(c) for p in points for c in p):
        return False
    points = drop_repeats(points)
    n = len(points) - 1
    if n < 3 or len(set(points[:-1])) != n:
        return False
    if n <= 12:  # the same test, without the setting up of arrays
        for i in range(n):
            for j in range(i + 1, n):
                if _clash(points, i, j, n):
                    return False
        return ring_area([(x - points[0][0], y - points[0][1]) for x, y in points]) != 0
    p = np.array(points)
    low, high = np.minimum(p[:-1], p[1:]), np.maximum(p[:-1], p[1:])
    order = np.argsort(low[:, 0], kind="stable")
    lows = low[order, 0]
    for rank, i in enumerate(order.tolist()):
        stop = np.searchsorted(lows, high[i, 0], side="right")
        for j in order[rank + 1 : stop].tolist():
            if low[j, 1] > high[i, 1] or high[j, 1] < low[i, 1]:
                continue
            if _clash(points, i, j, n):
                return False
    x, y = p[:-1, 0] - p[0, 0], p[:-1, 1] - p[0, 1]
    return bool(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) > 0)


def simplify_preserve(points: list[Point], epsilon: float, closed: bool) -> list[Point]:
    """Visvalingam-Whyatt: drop corners by rising area of their triangle, up to ``epsilon``.

    A corner stays where dropping it would make the new side meet another one. Ends stay; a ring keeps four points (the
    first one twice), a line two.
    """
    n, least = len(points), 4 if closed else 2
    if n <= least:
        return points
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    area = lambda i: abs(_side(*points[before[i]], *points[i], *points[after[i]])) / 2
    now = [math.inf, *(area(i) for i in range(1, n - 1)), math.inf]
    heap = [(now[i], i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    left = n
    cells: dict[tuple[int, int], set[int]] = defaultdict(set)  # sides by grid cell, under the index of their first point
    spread = max(max(p[0] for p in points) - min(p[0] for p in points), max(p[1] for p in points) - min(p[1] for p in points))
    size = max(spread / math.sqrt(n), 1e-9)

    def over(i: int, j: int) -> Iterator[tuple[int, int]]:
        (ax, ay), (bx, by) = points[i], points[j]
        for cx in range(math.floor(min(ax, bx) / size), math.floor(max(ax, bx) / size) + 1):
            for cy in range(math.floor(min(ay, by) / size), math.floor(max(ay, by) / size) + 1):
                yield cx, cy

    for i in range(n - 1):
        for cell in over(i, i + 1):
            cells[cell].add(i)

    def blocked(i: int) -> bool:
        a, c = before[i], after[i]
        seen: set[int] = set()
        for cell in over(a, c):
            for s in cells[cell]:
                if s in seen or not alive[s] or s in (a, i):
                    continue
                seen.add(s)
                p, q = points[s], points[after[s]]
                shared = {p, q} & {points[a], points[c]}
                if not shared:
                    if segments_meet(points[a], points[c], p, q):
                        return True
                elif len(shared) == 1:
                    corner = shared.pop()
                    far, own = (q if p == corner else p), (points[c] if points[a] == corner else points[a])
                    if _side(*corner, *own, *far) == 0 and (far[0] - corner[0]) * (own[0] - corner[0]) + (far[1] - corner[1]) * (own[1] - corner[1]) > 0:
                        return True
                else:
                    return True
        return False

    while heap and left > least:
        size_now, i = heapq.heappop(heap)
        if not alive[i] or size_now != now[i]:
            continue
        if size_now > epsilon:
            break
        if blocked(i):
            continue
        a, c = before[i], after[i]
        alive[i] = False
        left -= 1
        after[a], before[c] = c, a
        for cell in over(a, c):
            cells[cell].add(a)
        for j in (a, c):
            if 0 < j < n - 1:
                now[j] = max(area(j), size_now)
                heapq.heappush(heap, (now[j], j))
    return [p for p, keep in zip(points, alive) if keep]


def snap_ring(points: list[Point], grid: float) -> list[Point] | None:
    """Ring with its corners on the grid, or null if nothing valid is left."""
    if grid <= 0:
        return points
    away = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    out = drop_repeats([(away(x / grid) * grid, away(y / grid) * grid) for x, y in points])
    if out and out[0] != out[-1]:
        out.append(out[0])
    return out if len(out) >= 4 and valid_ring(out) else None


def ring_area(points: list) -> Fraction | float:
    """Signed area, above zero if counter-clockwise."""
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, points[1:])) / 2


def union_rings(rings: list[list[Point]], grid: float) -> list[list[Point]]:
    """Outer rings of the union of valid rings whose corners lie on the grid; holes are filled.

    In units of the grid all corners are integers, so crossings are exact fractions. Regions are merged two by two, halves
    of the plane first, so that what lies inside is gone before it meets the rest. In a merge every side is cut where it
    meets others; a piece belongs to the boundary if the union covers one of its sides only. The pieces are walked with the
    union on their left and parted where a walk meets itself.
    """
    whole = set()
    for ring in rings:
        r = [(round(x / grid), round(y / grid)) for x, y in ring]
        whole.add(tuple(r if ring_area(r) > 0 else r[::-1]))
    out: list[list[tuple]] = []
    for group in _touching([list(r) for r in _uncovered(sorted(whole))]):
        out += [r for r in _merge_all([[r] for r in sorted(group)]) if ring_area(r) > 0]
    return [[(float(x * Fraction(grid)), float(y * Fraction(grid))) for x, y in ring] for ring in out]


def _uncovered(rings: list[tuple]) -> list[tuple]:
    """Without the rings that lie within the box of an axis-parallel rectangle among them: the union is the same, and so are
    the groups of boxes that overlap. Each rectangle that stays is compared with what is left."""
    if len(rings) < 2:
        return rings
    box = np.array([(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for r in rings])
    fills = np.array([len(r) == 5 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(r, r[1:])) for r in rings])
    sizes = (box[:, 2] - box[:, 0]).astype(float) * (box[:, 3] - box[:, 1])
    kept, left = [], np.lexsort((~fills, -sizes))  # of equal boxes the rectangle first
    while len(left):
        i, left = left[0], left[1:]
        kept.append(int(i))
        if fills[i]:
            b = box[left]
            left = left[(b[:, 0] < box[i, 0]) | (b[:, 1] < box[i, 1]) | (b[:, 2] > box[i, 2]) | (b[:, 3] > box[i, 3])]
    return [rings[i] for i in sorted(kept)]


def _merge_all(regions: list[list[list[tuple]]]) -> list[list[tuple]]:
    """The rings (holes run clockwise) of the union of regions."""
    if len(regions) == 1:
        return regions[0]
    half = len(regions) // 2
    return _merge(_merge_all(regions[:half]), _merge_all(regions[half:]))


def _touching(rings: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Groups of rings whose boxes are linked by overlaps."""
    boxes = [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for r in rings]
    parent = list(range(len(rings)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    order, open_ = sorted(range(len(rings)), key=lambda i: boxes[i][0]), []
    for i in order:
        open_ = [j for j in open_ if boxes[j][2] >= boxes[i][0]]
        for j in open_:
            if boxes[j][1] <= boxes[i][3] and boxes[i][1] <= boxes[j][3]:
                parent[root(i)] = root(j)
        open_.append(i)
    groups: dict[int, list] = defaultdict(list)
    for i, r in enumerate(rings):
        groups[root(i)].append(r)
    return list(groups.values())


def _plus(start: int | Fraction, part: int | Fraction, whole: int | Fraction) -> int | Fraction:
    """start + part / whole, as an integer wherever it is one: those are many times faster."""
    if type(start) is type(part) is type(whole) is int:
        quotient, rest = divmod(part, whole)
        return start + Fraction(part, whole) if rest else start + quotient
    out = start + Fraction(part, whole)
    return out.numerator if out.denominator == 1 else out


def _cuts(a: tuple, b: tuple, c: tuple, d: tuple) -> list[tuple]:
    """Points of the segment ab where it meets cd."""
    dx, dy, ex, ey = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    cross = dx * ey - dy * ex
    if cross:
        t, u = (c[0] - a[0]) * ey - (c[1] - a[1]) * ex, (c[0] - a[0]) * dy - (c[1] - a[1]) * dx
        if cross < 0:
            t, u, cross = -t, -u, -cross
        if not (0 <= t <= cross and 0 <= u <= cross):
            return []
        if t in (0, cross):
            return [b if t else a]
        return [d if u else c] if u in (0, cross) else [(_plus(a[0], t * dx, cross), _plus(a[1], t * dy, cross))]
    if _side(*a, *b, *c):
        return []
    inside = lambda p: min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    return [p for p in (c, d) if inside(p)]


def _inside(twice: tuple, ring: list[tuple]) -> bool:
    """Whether a point that is not on the ring lies within it; given by twice its coordinates, to stay with integers."""
    odd, (x, y) = False, twice
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (2 * ay > y) != (2 * by > y) and ((x - 2 * ax) * (by - ay) < (y - 2 * ay) * (bx - ax)) == (by > ay):
            odd = not odd
    return odd


class _Cells:
    """Boxes by the cells of a coarse lattice that they touch."""

    def __init__(self, boxes: list[tuple]):
        spread = sum(max(x1 - x0, y1 - y0) for x0, x1, y0, y1 in boxes)
        self.size = max(1, math.ceil(spread / max(1, len(boxes))))
        self.members: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, box in enumerate(boxes):
            for cell in self.over(*box):
                self.members[cell].append(i)

    def over(self, x0, x1, y0, y1) -> Iterator[tuple[int, int]]:
        for cx in range(math.floor(x0 / self.size), math.floor(x1 / self.size) + 1):
            for cy in range(math.floor(y0 / self.size), math.floor(y1 / self.size) + 1):
                yield cx, cy

    def near(self, x0, x1, y0, y1) -> set[int]:
        return {i for cell in self.over(x0, x1, y0, y1) for i in self.members.get(cell, ())}


def _box(points: list[tuple]) -> tuple:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), max(xs), min(ys), max(ys)


def _merge(first: list[list[tuple]], second: list[list[tuple]]) -> list[list[tuple]]:
    """The rings of the union of two regions."""
    rings = [(k, r) for k, region in enumerate((first, second)) for r in region]
    sides = [(k, a, b) for k, r in rings for a, b in zip(r, r[1:])]
    spans, boxes = [_box((a, b)) for _, a, b in sides], [_box(r) for _, r in rings]
    side_cells, ring_cells = _Cells(spans), _Cells(boxes)
    pieces: dict[tuple, list[set]] = {}  # (low, high) -> regions with their inside to the left, to the right
    for (k, a, b), (x0, x1, y0, y1) in zip(sides, spans):
        on = {a, b}
        for i in side_cells.near(x0, x1, y0, y1):
            u0, u1, v0, v1 = spans[i]
            if u0 <= x1 and x0 <= u1 and v0 <= y1 and y0 <= v1:
                on.update(_cuts(a, b, sides[i][1], sides[i][2]))
        chain = sorted(on, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for p, q in zip(chain, chain[1:]):
            key = (min(p, q), max(p, q))
            pieces.setdefault(key, [set(), set()])[0 if key[0] == p else 1].add(k)
    leaving: dict[tuple, list[tuple]] = defaultdict(list)
    for (p, q), (left, right) in pieces.items():
        if bool(left) == bool(right):
            continue
        other = {0, 1} - left - right
        if other:
            twice = (p[0] + q[0], p[1] + q[1])
            mx, my = twice[0] / 2, twice[1] / 2  # a hint for the search only; the test is exact
            around = (rings[i][1] for i in ring_cells.near(mx - 1, mx + 1, my - 1, my + 1) if rings[i][0] in other)
            if sum(_inside(twice, r) for r in around) % 2:
                continue
        start, end = (p, q) if left else (q, p)
        leaving[start].append(end)
    return _walks(leaving)


def _walks(leaving: dict[tuple, list[tuple]]) -> list[list[tuple]]:
    """Rings from directed pieces by their start."""
    out = []
    while leaving:
        walk = [next(iter(leaving))]
        at = {walk[0]: 0}
        while True:
            ends = leaving[walk[-1]]
            if len(ends) > 1 and len(walk) > 1:  # the sharpest left turn stays with the same part of the union
                back = math.atan2(walk[-2][1] - walk[-1][1], walk[-2][0] - walk[-1][0])
                ends.sort(key=lambda e: (back - math.atan2(e[1] - walk[-1][1], e[0] - walk[-1][0])) % (2 * math.pi))
            end = ends.pop(0)
            if not ends:
                del leaving[walk[-1]]
            walk.append(end)
            if end in at:  # part off what is closed
                ring, walk = walk[at[end] :], walk[: at[end] + 1]
                for p in ring[1:-1]:
                    del at[p]
                if ring_area(ring) != 0:
                    out.append(_straight(ring))
                if len(walk) == 1:
                    break
            else:
                at[end] = len(walk) - 1
    return out


def _straight(ring: list[tuple]) -> list[tuple]:
    """Without corners on a straight side."""
    body = ring[:-1]
    kept = [p for i, p in enumerate(body) if _side(*body[i - 1], *p, *body[(i + 1) % len(body)]) != 0]
    return [*kept, kept[0]]


# ---------------------------------------------------------------- UDFs

NUMBERS = T.ArrayType(T.DoubleType())
SHAPE = T.StructType([T.StructField("xs", NUMBERS), T.StructField("ys", NUMBERS)])


def shape_points(xs, ys) -> list[Point]:
    return list(zip(map(float, xs), map(float, ys)))


def to_shape(points: list[Point] | None) -> dict | None:
    return None if points is None else {"xs": [p[0] for p in points], "ys": [p[1] for p in points]}


@F.udf(T.ArrayType(T.ArrayType(T.LongType())), useArrow=True)
def stitch_udf(segments):
    """stitch_rings over array<array<bigint>>, in member order."""
    return None if segments is None else stitch_rings([list(map(int, s)) for s in segments])


@F.pandas_udf(T.BooleanType())
def valid_ring_udf(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and valid_ring(shape_points(x, y)) for x, y in zip(xs, ys)])


def simplify_shape(points: list[Point], layer: str, lod: int, epsilon: float, snap_m: float) -> list[Point] | None:
    """What a layer keeps of a shape at a level, or null."""
    points = drop_repeats(points)
    if layer == "road":
        if len(points) < 2:
            return None
        return simplify_preserve(points, epsilon, False) if lod > 0 else points
    if points and points[0] != points[-1]:
        points = [*points, points[0]]
    if not valid_ring(points):
        return None
    before = len(points)
    if lod > 0:
        points = simplify_preserve(points, epsilon, True)
    if layer == "building" and snap_m > 0:
        return snap_ring(points, snap_m)
    return points if len(points) == before or valid_ring(points) else None


def _turns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether closed rings, one a row, of three or four corners turn the same way at every corner, clearly so."""
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    ex, ey = np.roll(dx, -1, 1), np.roll(dy, -1, 1)
    turn, least = dx * ey - dy * ex, 1e-6 * np.hypot(dx, dy) * np.hypot(ex, ey)
    return (turn > least).all(1) | (turn < -least).all(1)


def simplify_quads(x: np.ndarray, y: np.ndarray, layer: np.ndarray, lod: np.ndarray, epsilon: np.ndarray, snap_m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """simplify_shape for many closed rings of four corners at once: (done, null, points, x and y).

    Convex rings only, where it is plain that they are valid and that no corner is blocked; what is not ``done`` is left to
    simplify_shape. Of a ring with ``points`` 4 the last column means nothing.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        done = np.isfinite(x).all(1) & np.isfinite(y).all(1) & (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4]) & (layer != "road") & (np.abs(x).max(1) < 1e9) & (np.abs(y).max(1) < 1e9)
        done &= _turns(x, y)
        area = np.abs(np.stack([_side(x[:, i - 1], y[:, i - 1], x[:, i], y[:, i], x[:, i + 1], y[:, i + 1]) for i in (1, 2, 3)], 1)) / 2
        drop = (lod > 0) & (area.min(1) <= epsilon)
        rest = np.arange(4)[None, :] + (np.arange(4)[None, :] >= area.argmin(1)[:, None] + 1)
        x, y, points = x.copy(), y.copy(), np.where(drop, 4, 5)
        for v in (x, y):
            v[drop, :4] = np.take_along_axis(v, rest, 1)[drop]
            v[drop, 4] = v[drop, 0]
        snap = (layer == "building") & (snap_m > 0)
        for v in (x, y):
            grid = snap_m[snap, None]
            v[snap] = np.copysign(np.floor(np.abs(v[snap] / grid) + 0.5), v[snap] / grid) * grid
        null = snap & ((np.ptp(x, axis=1) == 0) | (np.ptp(y, axis=1) == 0))
        valid = np.where(drop, _turns(x[:, :4], y[:, :4]), _turns(x, y))
    return done & (null | valid), null, points, x, y


@F.pandas_udf(SHAPE)
def simplify_udf(xs: pd.Series, ys: pd.Series, layer: pd.Series, lod: pd.Series, epsilon: pd.Series, snap_m: pd.Series) -> pd.DataFrame:
    more = layer, lod, epsilon, snap_m
    quad = np.array([x is not None and y is not None and len(x) == len(y) == 5 for x, y in zip(xs, ys)], bool)
    quad &= ~pd.concat([c.isna() for c in more], axis=1).any(axis=1).to_numpy()
    out_x, out_y, at = np.full(len(xs), None, object), np.full(len(xs), None, object), np.flatnonzero(quad)
    if len(at):
        number = lambda rows: np.array([np.asarray(r, float) for r in rows.to_numpy()[at]])
        done, null, points, x, y = simplify_quads(number(xs), number(ys), *(c.to_numpy()[at] for c in more))
        for i in np.flatnonzero(done & ~null).tolist():
            out_x[at[i]], out_y[at[i]] = x[i, : points[i]], y[i, : points[i]]
        quad[at[~done]] = False
    slow = np.flatnonzero(~quad)
    if len(slow):
        rest = _shapes(*(c.iloc[slow] for c in (xs, ys)), simplify_shape, *(c.iloc[slow] for c in more))
        for i, x, y in zip(slow.tolist(), rest["xs"], rest["ys"]):
            out_x[i], out_y[i] = x, y
    return pd.DataFrame({"xs": out_x, "ys": out_y})


#: Not that it were random: so marked, Catalyst neither copies it into a filter on its result nor evaluates it once more for
#: every field that is read.
simplify_once = simplify_udf.asNondeterministic()


@F.pandas_udf(SHAPE)
def drop_repeats_udf(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return _shapes(xs, ys, drop_repeats)


@F.pandas_udf(SHAPE)
def snap_ring_udf(xs: pd.Series, ys: pd.Series, grid: pd.Series) -> pd.DataFrame:
    return _shapes(xs, ys, snap_ring, grid)


def _shapes(xs: pd.Series, ys: pd.Series, kernel, *more: pd.Series) -> pd.DataFrame:
    out = [to_shape(kernel(shape_points(x, y), *rest)) if x is not None and y is not None else None for x, y, *rest in zip(xs, ys, *more)]
    return pd.DataFrame({"xs": [o and o["xs"] for o in out], "ys": [o and o["ys"] for o in out]})


@F.udf(T.ArrayType(SHAPE), useArrow=True)
def union_rings_udf(shapes, grid):
    """union_rings over array<struct<xs,ys>>; rings that are not valid on the grid are left out."""
    if shapes is None or grid is None or grid <= 0:
        return None
    rings = [snap_ring(shape_points(r["xs"], r["ys"]), grid) for r in shapes if r is not None]
    return [to_shape(r) for r in union_rings([r for r in rings if r], grid)]


def register(spark) -> None:
    """The kernels under names for SQL: stitch_rings, is_valid_ring, simplify_shape, drop_repeats, snap_ring, union_rings."""
    spark.udf.register("stitch_rings", stitch_udf)
    spark.udf.register("is_valid_ring", valid_ring_udf)
    spark.udf.register("simplify_shape", simplify_udf)
    spark.udf.register("drop_repeats", drop_repeats_udf)
    spark.udf.register("snap_ring", snap_ring_udf)
    spark.udf.register("union_rings", union_rings_udf)
