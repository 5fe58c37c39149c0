"""Exact overlay of squares and lines with perimeters.

A perimeter is a parameter, so its edges are one array literal in the plan, or numpy arrays
beside it: cells and lines stay where they are, and only sums are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.functions.norm import let
from atrisk.operators.exposure import Bands
from atrisk.operators.shared import finely

#: How many pairs of a segment and an edge are held at once.
CROSSED = 1 << 16


def _oriented(polygons: list[geom.Polygon]) -> list[tuple[float, float, float, float]]:
    """Edges that run counter-clockwise on outer rings and clockwise on holes."""
    out = []
    for polygon in polygons:
        for i, ring in enumerate(polygon):
            sides = geom.edges(ring)
            positive = sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in sides) > 0
            out += sides if positive == (i == 0) else [(x2, y2, x1, y1) for x1, y1, x2, y2 in sides]
    return out


def square_share(x0: Column, y0: Column, size: Column, polygons: list[geom.Polygon]) -> Column:
    """Share of an axis-parallel square that lies in polygons which don't overlap.

    By Green's theorem every edge adds the integral, over the square's range of y, of its x
    held within the square; so no clipped shape is ever built.
    """
    x1, y1 = x0 + size, y0 + size

    def primitive(z: Column) -> Column:
        """Of z held to the square, less x0."""
        held = F.least(F.greatest(z, x0), x1) - x0
        return held * held / 2 + F.greatest(z - x1, F.lit(0.0)) * size

    def add(total, xa, ya, xb, yb) -> Column:
        low, high = F.greatest(F.least(ya, yb), y0), F.least(F.greatest(ya, yb), y1)
        at = lambda y: xa + (y - ya) * (xb - xa) / F.nullif(yb - ya, F.lit(0.0))
        left, right = at(low), at(high)
        mean = F.coalesce((primitive(right) - primitive(left)) / F.nullif(right - left, F.lit(0.0)), F.least(F.greatest(left, x0), x1) - x0)
        return total + F.when((ya != yb) & (high > low), F.signum(yb - ya) * (high - low) * mean).otherwise(0.0)

    return geom.each_edge(_oriented(polygons), F.lit(0.0), add) / (size * size)


def cells_in_bands(cells: DataFrame, bands: Bands) -> DataFrame:
    """``cell_id, population, band_index, share``: each cell with every band that covers some
    of it, overlapping bands each on their own. Cells have ``x0, y0, size``."""
    def near(polygons) -> Column:
        a, b, c, d = geom.envelope(polygons)
        return (F.col("x0") <= c) & (F.col("x0") + F.col("size") >= a) & (F.col("y0") <= d) & (F.col("y0") + F.col("size") >= b)

    each = F.array_compact(F.array(*(F.when(near(p), F.struct(F.lit(i).alias("band_index"), square_share(F.col("x0"), F.col("y0"), F.col("size"), p).alias("share"))) for i, (*_, p) in enumerate(bands))))
    return cells.select("cell_id", "population", F.inline(each)).filter("share > 1e-12").withColumn("share", F.least("share", F.lit(1.0)))


def _crossing_levels(sides: np.ndarray) -> np.ndarray:
    """Every y at which edges begin, end or cross one another."""
    x1, y1, x2, y2 = sides.T
    dx, dy = x2 - x1, y2 - y1
    out = [y1, y2]
    for i in range(len(sides)):  # edge by edge, so memory grows with the edges only
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = dx[i] * dy - dy[i] * dx
            t = ((x1 - x1[i]) * dy - (y1 - y1[i]) * dx) / cross
            u = ((x1 - x1[i]) * dy[i] - (y1 - y1[i]) * dx[i]) / cross
        hit = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append(y1[i] + t[hit] * dy[i])
    return np.unique(np.concatenate(out))


def exclusive_shares(cells: DataFrame, bands: Bands) -> DataFrame:
    """``cell_id, population, band_index, share``: how much of each square cell (``x0, y0, size``)
    lies in a band and in none before it, exactly, however bands and their polygons overlap.
    A cell's shares add up to its share in the union of all bands. Rings follow the even-odd
    rule, so they may cross themselves; there may be 62 in all.

    A cell is cut into levels between which no edges cross or leave it. On a level every
    piece is a trapezoid, so its width half way up times the height is its area.
    """
    rings = [(k, p, r, ring) for k, (*_, shape) in enumerate(bands) for p, polygon in enumerate(shape) for r, ring in enumerate(polygon)]
    if len(rings) > 62:
        raise ValueError("at most 62 rings")
    rows = [(*e, n) for n, (*_, ring) in enumerate(rings) for e in geom.edges(ring) if e[1] != e[3]]
    table = np.asarray([r[:4] for r in rows], dtype=np.float64)
    flat, levels = F.lit(table.reshape(-1)), F.lit(_crossing_levels(table))
    masks = F.lit(np.asarray([1 << r[4] for r in rows], dtype=np.int64))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("size"), F.col("y0") + F.col("size")
    edge = lambda i, body: let(F.slice(flat, i * 4 + 1, F.lit(4)), lambda e: body(*(F.get(e, F.lit(k)) for k in range(4))))
    at_y = lambda y, ax, ay, bx, by: ax + (y - ay) * (bx - ax) / (by - ay)
    number = {(k, p, r): n for n, (k, p, r, _) in enumerate(rings)}

    def within(mask: Column, k: int) -> Column:
        out = F.lit(False)
        for p, polygon in enumerate(bands[k][2]):
            own = [1 << number[k, p, r] for r in range(len(polygon))]
            out = out | (mask.bitwiseAND(F.lit(sum(own))) == own[0])
        return out

    def widths(y: Column, near: Column) -> Column:
        """By band, the width at y of what no band before holds."""
        met = lambda i: edge(i, lambda ax, ay, bx, by: F.when((ay > y) != (by > y), F.struct(at_y(y, ax, ay, bx, by).alias("x"), F.get(masks, i).alias("m"))))
        start = F.struct(x0.alias("at"), F.lit(0).cast("long").alias("mask"), *(F.lit(0.0).alias(f"w{k}") for k in range(len(bands))))

        def step(s: Column, c: Column) -> Column:
            def moved(x: Column) -> Column:
                owner = F.coalesce(*(F.when(within(s["mask"], k), k) for k in range(len(bands))), F.lit(-1))
                return let(F.struct(x.alias("x"), owner.alias("o")), lambda v: F.struct(v["x"].alias("at"), s["mask"].bitwiseXOR(c["m"]).alias("mask"), *((s[f"w{k}"] + F.when(v["o"] == k, v["x"] - s["at"]).otherwise(0.0)).alias(f"w{k}") for k in range(len(bands)))))

            return moved(F.least(F.greatest(c["x"], x0), x1))

        return F.aggregate(F.array_sort(F.array_compact(F.transform(near, met))), start, step)

    def areas(near: Column) -> Column:
        side = lambda x: F.transform(near, lambda i: edge(i, lambda ax, ay, bx, by: F.when((F.least(ax, bx) < x) & (F.greatest(ax, bx) > x), ay + (x - ax) * (by - ay) / (bx - ax))))
        inner = F.filter(F.array_compact(F.concat(levels, side(x0), side(x1))), lambda y: (y > y0) & (y < y1))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(y0, y1), inner)))
        zero = F.struct(*(F.lit(0.0).alias(f"w{k}") for k in range(len(bands))))

        def sums(c: Column) -> Column:
            def add(s: Column, i: Column) -> Column:
                low, high = F.get(c, i), F.get(c, i + 1)
                return let(widths((low + high) / 2, near), lambda w: F.struct(*((s[f"w{k}"] + w[f"w{k}"] * (high - low)).alias(f"w{k}") for k in range(len(bands)))))

            return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), zero, add)

        return let(cuts, sums)

    near = F.filter(F.sequence(F.lit(0), F.lit(len(rows) - 1)), lambda i: edge(i, lambda ax, ay, bx, by: (F.least(ay, by) < y1) & (F.greatest(ay, by) > y0)))
    reached = geom.envelope([p for *_, shape in bands for p in shape])
    over = cells.filter((x0 <= reached[2]) & (x1 >= reached[0]) & (y0 <= reached[3]) & (y1 >= reached[1]))
    each = let(let(near, areas), lambda a: F.array(*(F.struct(F.lit(k).alias("band_index"), (a[f"w{k}"] / (F.col("size") * F.col("size"))).alias("share")) for k in range(len(bands)))))
    return over.select("cell_id", "population", F.inline(each)).filter("share > 1e-12").withColumn("share", F.least("share", F.lit(1.0)))


def inside_metres(polygons: list[geom.Polygon], ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """How much of each segment lies inside, NaN where no part does: segments are cut where they
    meet edges, and parts whose middle is inside by the even-odd rule are summed."""
    rings = [(p, r, np.asarray(geom.edges(ring), dtype=np.float64)) for p, polygon in enumerate(polygons) for r, ring in enumerate(polygon)]
    px, py, qx, qy = np.concatenate([e for *_, e in rings]).T

    def holds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(polygons), len(x)), dtype=bool)
        for p, r, e in rings:
            x1, y1, x2, y2 = e[e[:, 1] != e[:, 3]].T
            level, across = y[:, None], x[:, None]
            crossed = ((y2 > level) != (y1 > level)) & (across < (level - y2) * (x1 - x2) / (y1 - y2) + x2)
            odd = crossed.sum(axis=1) % 2 == 1
            out[p] = odd if r == 0 else out[p] & ~odd
        return out.any(axis=0)

    def each(ax, ay, bx, by) -> np.ndarray:
        n, dx, dy = len(ax), bx - ax, by - ay
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = dx[:, None] * (qy - py) - dy[:, None] * (qx - px)
            east, north = px - ax[:, None], py - ay[:, None]
            on_segment, on_edge = (east * (qy - py) - north * (qx - px)) / cross, (east * dy[:, None] - north * dx[:, None]) / cross
            row, edge = np.nonzero((cross != 0) & (on_segment > 0) & (on_segment < 1) & (on_edge >= 0) & (on_edge <= 1))
        of, t = np.concatenate([np.arange(n), row, np.arange(n)]), np.concatenate([np.zeros(n), on_segment[row, edge], np.ones(n)])
        order = np.lexsort((t, of))
        of, t = of[order], t[order]
        part = np.nonzero((of[1:] == of[:-1]) & (t[1:] > t[:-1]))[0]
        of, t0, t1 = of[part], t[part], t[part + 1]
        at = lambda t, of: (ax[of] + dx[of] * t, ay[of] + dy[of] * t)
        within = holds(*at((t0 + t1) / 2, of))
        of, t0, t1 = of[within], t0[within], t1[within]
        metres = np.full(n, np.nan)
        metres[of] = 0.0
        np.add.at(metres, of, geom.haversine_np(*at(t0, of), *at(t1, of)))
        return metres

    step = max(1, CROSSED // len(px))
    return np.concatenate([each(*(v[i : i + step] for v in (ax, ay, bx, by))) for i in range(0, len(ax), step)] or [np.empty(0)])


def _segments(lines: DataFrame) -> DataFrame:
    """``id, kind, ax, ay, bx, by`` of lines, or of their vertices (``id, kind, seq, x, y``), each of
    which is joined to the next by a window: no line is gathered into an array."""
    if "points" not in lines.columns:
        to_next = Window.partitionBy("id", "kind").orderBy("seq")
        ends = finely(lines, "id", "kind").select("id", "kind", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead(F.struct("x", "y")).over(to_next).alias("b"))
        return ends.filter("b is not null").select("id", "kind", "ax", "ay", F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    points = F.col("points")
    pairs = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
    return lines.filter(F.size(points) > 1).select("id", "kind", F.explode(pairs).alias("s")).select("id", "kind", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def clipped_lines(lines: DataFrame, polygons: list[geom.Polygon]) -> DataFrame:
    """``id, kind, metres``: how much of each line lies inside. Lines have ``points`` of x, y, or
    come as vertices, a row each, ``id, kind, seq, x, y``.

    Segments in the envelope are cut by :func:`inside_metres`, a batch at a time. A line with
    less than two points, or all outside, gives no row.
    """
    x0, y0, x1, y1 = geom.envelope(polygons)
    segments = _segments(lines)
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    near = (F.least(ax, bx) <= x1) & (F.greatest(ax, bx) >= x0) & (F.least(ay, by) <= y1) & (F.greatest(ay, by) >= y0)

    @F.pandas_udf("double")
    def metres(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(inside_metres(polygons, *(v.to_numpy(dtype=np.float64) for v in (ax, ay, bx, by))))

    # sums are null where no part is inside; a filter below them would compute the parts twice
    return segments.filter(near).groupBy("id", "kind").agg(F.sum(metres(ax, ay, bx, by)).alias("metres")).filter("metres is not null")
