"""Shapes against shapes as array expressions: footprints in perimeters, tiles of shapes.

A shape is its rings (an array of arrays of structs x, y), an outer one and holes in any
order, closed or not. All tests take boundaries as part of the shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.functions.norm import let

SHAPE = "array<array<struct<x:double,y:double>>>"


def shapes_of(polygons: list[geom.Polygon]) -> Column:
    """An array of shapes, one for each polygon, as polygons may overlap."""
    return F.array(*(F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring)) for ring in polygon)) for polygon in polygons))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def sides(rings: Column) -> Column:
    """All edges as structs ``a, b`` of points."""
    return F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(F.get(r, i).alias("a"), F.get(r, (i + 1) % F.size(r)).alias("b")))))


def _turn(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _between(p: Column, q: Column, r: Column) -> Column:
    """Whether r, in line with p and q, lies on their edge."""
    return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))


def edges_meet(e: Column, f: Column) -> Column:
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    turns = F.struct(_turn(a, b, c).alias("c"), _turn(a, b, d).alias("d"), _turn(c, d, a).alias("a"), _turn(c, d, b).alias("b"))
    near = (F.least(a["x"], b["x"]) <= F.greatest(c["x"], d["x"])) & (F.greatest(a["x"], b["x"]) >= F.least(c["x"], d["x"])) & (F.least(a["y"], b["y"]) <= F.greatest(c["y"], d["y"])) & (F.greatest(a["y"], b["y"]) >= F.least(c["y"], d["y"]))

    def meet(t: Column) -> Column:
        on = ((t["c"] == 0) & _between(a, b, c)) | ((t["d"] == 0) & _between(a, b, d)) | ((t["a"] == 0) & _between(c, d, a)) | ((t["b"] == 0) & _between(c, d, b))
        return on | ((t["c"] * t["d"] < 0) & (t["a"] * t["b"] < 0))

    return near & let(turns, meet)


def holds(edges: Column, p: Column) -> Column:
    """Whether a shape, by its edges, holds a point by the even-odd rule over all rings."""
    over = lambda n, e: n + F.when(((e["b"]["y"] > p["y"]) != (e["a"]["y"] > p["y"])) & (p["x"] < (p["y"] - e["b"]["y"]) * (e["a"]["x"] - e["b"]["x"]) / F.nullif(e["a"]["y"] - e["b"]["y"], F.lit(0.0)) + e["b"]["x"]), 1).otherwise(0)
    return F.aggregate(edges, F.lit(0), over) % 2 == 1


def meets(one: Column, other: Column) -> Column:
    """Whether two shapes share a point: edges that meet, or a ring of one within the other.
    Without an edge that meets, a ring lies wholly in or out, so one vertex of it tells."""

    def test(s: Column) -> Column:
        a, b = s["a"], s["b"]
        within = lambda rings, edges: F.exists(rings, lambda r: holds(edges, F.get(r, F.lit(0))))
        return F.exists(a, lambda e: F.exists(b, lambda f: edges_meet(e, f))) | within(one, b) | within(other, a)

    return let(F.struct(sides(one).alias("a"), sides(other).alias("b")), test)


def _apart(i: Column, j: Column, n: Column) -> Column:
    """Whether two edges of a ring of n are no neighbours."""
    return (j > i + 1) & ~((i == 0) & (j == n - 1))


def crosses_itself(ring: Column) -> Column:
    """Whether edges of a ring that are no neighbours meet."""
    def test(e: Column) -> Column:
        n = F.size(e)
        places = F.sequence(F.lit(0), n - 1)
        return F.exists(places, lambda i: F.exists(places, lambda j: _apart(i, j, n) & edges_meet(F.get(e, i), F.get(e, j))))

    return let(sides(F.array(opened(ring))), test)


def opened(ring: Column) -> Column:
    """A ring without the last point where that repeats the first."""
    last, first = F.element_at(ring, -1), F.get(ring, F.lit(0))
    return F.when((F.size(ring) > 1) & (last["x"] == first["x"]) & (last["y"] == first["y"]), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def even_odd_area(ring: Column) -> Column:
    """The area that a ring holds by the even-odd rule, also where it crosses itself, in square
    units: between levels at which edges begin, end or cross all pieces are trapezoids."""

    def swept(e: Column) -> Column:
        def crossing(a: Column, b: Column) -> Column:
            dx, dy = a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"]
            ex, ey = b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
            px, py = b["a"]["x"] - a["a"]["x"], b["a"]["y"] - a["a"]["y"]
            cross = F.nullif(dx * ey - dy * ex, F.lit(0.0))
            t, u = (px * ey - py * ex) / cross, (px * dy - py * dx) / cross
            return F.when(t.between(0, 1) & u.between(0, 1), a["a"]["y"] + t * dy)

        ys = F.concat(F.transform(e, lambda s: s["a"]["y"]), F.flatten(F.transform(e, lambda a: F.transform(e, lambda b: crossing(a, b)))))
        width = lambda y: F.aggregate(F.array_sort(F.array_compact(F.transform(e, lambda s: F.when((s["a"]["y"] > y) != (s["b"]["y"] > y), s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"]))))), F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")))["sum"]
        return let(F.array_sort(F.array_distinct(F.array_compact(ys))), lambda c: F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), F.lit(0.0), lambda s, i: s + F.coalesce((F.get(c, i + 1) - F.get(c, i)) * width((F.get(c, i) + F.get(c, i + 1)) / 2), F.lit(0.0))))

    return let(sides(F.array(opened(ring))), swept)


def ring_note(ring: Column) -> Column:
    """What is wrong with a ring, of which all is mended: not closed or too short, or it
    crosses itself and counts by the even-odd rule; null for a sound one."""
    last, first = F.element_at(ring, -1), F.get(ring, F.lit(0))
    unclosed = (F.size(ring) < 4) | (last["x"] != first["x"]) | (last["y"] != first["y"])
    notes = F.array_compact(F.array(F.when(unclosed, "not closed"), F.when(crosses_itself(ring), "crosses itself")))
    return F.nullif(F.array_join(notes, ", "), F.lit(""))


def envelope(rings: Column) -> Column:
    """``x0, y0, x1, y1`` of a shape."""
    of = lambda c: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[c])))
    return F.struct(F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x")).alias("x1"), F.array_max(of("y")).alias("y1"))


def in_perimeter(assets: DataFrame, polygons: list[geom.Polygon], rings: str = "rings") -> DataFrame:
    """The assets whose footprint, where there is one, shares a point with the perimeter;
    others go by their point, the boundary included. Envelopes are compared first."""
    x0, y0, x1, y1 = geom.envelope(polygons)
    at = geom.located(F.col("lon"), F.col("lat"), [[p] for p in polygons])
    by_point = let(at, lambda s: F.exists(s["inside"], lambda i: i) | s["touches"])
    near = let(envelope(F.col(rings)), lambda e: (e["x0"] <= x1) & (e["x1"] >= x0) & (e["y0"] <= y1) & (e["y1"] >= y0))
    shaped = F.size(F.coalesce(F.col(rings), F.array().cast(SHAPE))) > 0
    return assets.filter(F.when(shaped, near & F.exists(shapes_of(polygons), lambda p: meets(F.col(rings), p))).otherwise(F.coalesce(by_point, F.lit(False))))


def tiles(shapes: DataFrame, step: float = 0.05, rings: str = "rings") -> DataFrame:
    """``ix, iy, tile_key`` beside the columns of each shape: a row for each tile of a fixed
    grid that it touches. Of the tiles under its envelope those stay that share a point with
    it; a shape without rings touches none."""
    e = shapes.filter(F.size(rings) > 0).withColumn("__e", envelope(F.col(rings)))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))
    under = e.select("*", span("__e.x0", "__e.x1").alias("ix")).select("*", span("__e.y0", "__e.y1").alias("iy"))
    edge = lambda c, n: (F.col(c) + n) * step
    touched = under.filter(meets(F.col(rings), box(edge("ix", 0), edge("iy", 0), edge("ix", 1), edge("iy", 1))))
    return touched.drop("__e").withColumn("tile_key", F.concat_ws("/", F.lit(f"{step:g}"), F.col("ix").cast("string"), F.col("iy").cast("string")))
