"""Planar geometry on lon/lat columns against parameter-sized polygons.

A perimeter is a request parameter (a few bands of up to some thousand vertices), so its
edges become part of the expression, next to the scan, and need neither a join nor a
shuffle: few edges one by one within code generation, many as one array literal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
#: A polygon is its outer ring and its holes; a band has one polygon or more.
Polygon = list[Ring]

# Fixed value: metres per degree of latitude in the local equirectangular projection.
DEG_LAT_M = 111_320.0
#: More edges than these are one array in the plan rather than an expression each.
UNROLLED = 24


def edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    """Each vertex with the next and the last with the first; a ring may repeat its first
    vertex at the end, as edges without length are left out."""
    return [(*a, *b) for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True) if tuple(a) != tuple(b)]


def each_edge(sides: list[tuple[float, float, float, float]], start: Column, step) -> Column:
    """Folds ``step(so far, x1, y1, x2, y2)`` over edges held as one array literal."""
    flat = F.lit(np.asarray(sides, dtype=np.float64).reshape(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(sides) - 1)), start, lambda s, i: step(s, *(F.get(flat, i * 4 + k) for k in range(4))))


def envelope(polygons: list[Polygon]) -> tuple[float, float, float, float]:
    points = [p for polygon in polygons for p in polygon[0]]
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def in_envelope(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of edges."""
    sides = edges(ring)
    if len(sides) > UNROLLED:
        over = lambda n, xj, yj, xi, yi: n + F.when(((yi > y) != (yj > y)) & (x < (y - yi) * (xj - xi) / F.nullif(yj - yi, F.lit(0.0)) + xi), 1).otherwise(0)
        return each_edge(sides, F.lit(0), over) % 2 == 1
    crossed = [F.when(((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (y - yi) * (xj - xi) / (yj - yi) + xi), 1).otherwise(0) for xj, yj, xi, yi in sides if yi != yj]
    return reduce(lambda a, b: a + b, crossed) % 2 == 1


def on_edges(x: Column, y: Column, polygons: list[Polygon]) -> Column:
    """Whether the point lies on an edge of a ring or hole, where the even-odd rule is
    open on some sides."""
    sides = [e for polygon in polygons for ring in polygon for e in edges(ring)]
    if len(sides) > UNROLLED:
        hit = lambda s, x1, y1, x2, y2: s | (x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2)) & ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)))
        return each_edge(sides, F.lit(False), hit)
    on = [x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)) & ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) for x1, y1, x2, y2 in sides]
    return reduce(lambda a, b: a | b, on)


def located(x: Column, y: Column, shapes: list[list[Polygon]]) -> Column:
    """``inside`` (whether each shape, of one polygon or more, holds the point by the even-odd
    rule) and ``touches`` (whether the point lies on any edge), in one pass.

    Edges are dealt to strips of y in one array literal, and a point looks only at those of
    its strip: a few, however many vertices there are, and the plan doesn't grow with them.
    """
    rings = [(k, p, r, ring) for k, shape in enumerate(shapes) for p, polygon in enumerate(shape) for r, ring in enumerate(polygon)]
    sides = [(n, e) for n, (*_, ring) in enumerate(rings) for e in edges(ring)]
    low = min(min(e[1], e[3]) for _, e in sides)
    high = max(max(e[1], e[3]) for _, e in sides)
    strips = max(1, min(1 << 14, len(sides)))
    height = (high - low) / strips or 1.0
    held: list[list[float]] = [[] for _ in range(strips)]
    for n, e in sides:
        # a strip more on either side, as the point's strip is rounded too
        first, last = (int((v - low) / height) for v in sorted((e[1], e[3])))
        for i in range(max(0, first - 1), min(strips, last + 2)):
            held[i] += [*e, float(n)]
    flat = F.lit(np.asarray([v for h in held for v in h], dtype=np.float64))
    starts = F.lit(np.concatenate([[0], np.cumsum([len(h) // 5 for h in held])]).astype(np.int32))
    words = -(-len(rings) // 62)
    none = F.struct(*(F.lit(0).cast("long").alias(f"w{w}") for w in range(words)), F.lit(False).alias("touches"))
    masks = F.lit(np.asarray([1 << n % 62 for n in range(len(rings))], dtype=np.int64))

    def step(so_far: Column, i: Column) -> Column:
        return F.get(F.transform(F.array(F.slice(flat, i * 5 + 1, F.lit(5))), lambda e: added(so_far, *(F.get(e, F.lit(k)) for k in range(5)))), F.lit(0))

    def added(so_far: Column, x1, y1, x2, y2, ring) -> Column:
        crosses = ((y2 > y) != (y1 > y)) & (x < (y - y2) * (x1 - x2) / F.nullif(y1 - y2, F.lit(0.0)) + x2)
        on = x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2)) & ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1))
        turned = [so_far[f"w{w}"].bitwiseXOR(F.when(crosses & (F.floor(ring / 62) == w), F.get(masks, ring.cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
        return F.struct(*turned, (so_far["touches"] | on).alias("touches"))

    strip = F.least(F.floor((y - low) / height), F.lit(strips - 1)).cast("int")
    first, end = F.get(starts, strip), F.get(starts, strip + 1)
    seen = F.when(y.between(low, high) & (end > first), F.aggregate(F.sequence(first, end - 1), none, step)).otherwise(none)

    def told(s: Column) -> Column:
        odd = lambda n: s[f"w{n // 62}"].bitwiseAND(F.lit(1 << n % 62)) != 0
        number = {(k, p, r): n for n, (k, p, r, _) in enumerate(rings)}
        within = [reduce(lambda a, b: a | b, (reduce(lambda a, h: a & ~odd(number[k, p, h]), range(1, len(polygon)), odd(number[k, p, 0])) for p, polygon in enumerate(shape))) for k, shape in enumerate(shapes)]
        return F.struct(F.array(*within).alias("inside"), s["touches"].alias("touches"))

    return F.get(F.transform(F.array(seen), told), F.lit(0))


def in_polygons(x: Column, y: Column, polygons: list[Polygon]) -> Column:
    """Inside any polygon and in none of its holes; the envelope is tested first."""
    tests = [reduce(lambda a, hole: a & ~in_ring(x, y, hole), outer[1:], in_envelope(x, y, envelope([outer])) & in_ring(x, y, outer[0])) for outer in polygons]
    return reduce(lambda a, b: a | b, tests)


def distance_m(x: Column, y: Column, polygons: list[Polygon]) -> Column:
    """Metres to the nearest boundary segment, projected at the point's latitude."""
    sides = [e for polygon in polygons for ring in polygon for e in edges(ring)]
    k = F.cos(F.radians(y))

    def apart(x1, y1, x2, y2) -> Column:
        ax, ay, dy = k * (x1 * DEG_LAT_M), y1 * DEG_LAT_M, (y2 - y1) * DEG_LAT_M
        dx = k * ((x2 - x1) * DEG_LAT_M)
        px, py = k * x * DEG_LAT_M - ax, y * DEG_LAT_M - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
        return F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2))

    if len(sides) > UNROLLED:
        return each_edge(sides, F.lit(float("inf")), lambda s, *e: F.least(s, apart(*e)))
    out = [apart(*e) for e in sides]
    return F.least(*out) if len(out) > 1 else out[0]


def in_envelopes(x: Column, y: Column, polygons: list[Polygon], metres: float) -> Column:
    """Within the perimeter's envelope, put out by some metres."""
    x0, y0, x1, y1 = envelope(polygons)
    dy = metres / DEG_LAT_M
    dx = dy / max(1e-6, float(np.cos(np.radians(min(89.9, max(abs(y0), abs(y1)) + dy)))))
    return in_envelope(x, y, (x0 - dx, y0 - dy, x1 + dx, y1 + dy))


def within_m(x: Column, y: Column, polygons: list[Polygon], metres: float) -> Column:
    """Inside the perimeter or at most so many metres from its boundary: a buffer as a test."""
    return in_envelopes(x, y, polygons, metres) & (in_polygons(x, y, polygons) | (distance_m(x, y, polygons) <= metres))


def shoelace(points: Column, x: str = "x", y: str = "y") -> Column:
    """Signed double area of a ring of points (structs), in square degrees."""
    n = F.size(points)
    at = lambda i: F.get(points, i % n)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i)[x] * at(i + 1)[y] - at(i + 1)[x] * at(i)[y])


def tile_index(v: Column, step: float) -> Column:
    return F.floor(v / F.lit(step)).cast("long")


def tile_key(x: Column, y: Column, step: float = 0.05) -> Column:
    return F.concat_ws("/", F.lit(f"{step:g}"), tile_index(x, step).cast("string"), tile_index(y, step).cast("string"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(a)) * (2 * 6371008.8)


def haversine_np(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """:func:`haversine_m` on arrays."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.arcsin(np.sqrt(a)) * (2 * 6371008.8)


def circle(lon: Column, lat: Column, radius_km: Column, points: int = 48) -> Column:
    """A ring (structs x, y) that is round on the ground; null for a radius that is not
    above 0 and at most 200 km."""
    up = radius_km * 1000 / DEG_LAT_M
    across = up / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    turn = lambda i: i * F.lit(2 * float(np.pi) / points)
    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((lon + across * F.cos(turn(i))).alias("x"), (lat + up * F.sin(turn(i))).alias("y")))
    return F.when((radius_km > 0) & (radius_km <= 200), ring)
