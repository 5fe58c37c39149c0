"""Overlays against closed forms and fine sampling; rate decisions against a plain loop; ingest that is repeated."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.operators import clip, store
from atrisk.sources import fixtures as fx
from atrisk.streaming import usage

SQUARE = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]


def test_square_share_closed_forms(spark):
    rows = [("in", 2.5, 2.5, 1.0, 1.0), ("out", 5.0, 0.0, 1.0, 0.0), ("half", 3.5, 0.0, 1.0, 0.5), ("corner", 3.5, 3.5, 1.0, 0.25), ("hole", 1.25, 1.25, 0.5, 0.0), ("round the hole", 0.5, 0.5, 2.0, 0.75), ("whole", -1.0, -1.0, 8.0, 15 / 64)]
    df = spark.createDataFrame(rows, "name string, x double, y double, size double, want double")
    got = df.select("name", clip.square_share(F.col("x"), F.col("y"), F.col("size"), [SQUARE]).alias("got"), "want").collect()
    assert all(abs(r["got"] - r["want"]) < 1e-12 for r in got), got


def test_square_share_by_sampling(spark):
    rng = random.Random(3)
    star = [[(math.cos(a) * r, math.sin(a) * r) for a, r in ((2 * math.pi * i / 90, rng.uniform(0.3, 1.0)) for i in range(90))]]
    cells = spark.range(16).select(F.col("id"), ((F.col("id") % 4) * 0.5 - 1).alias("x"), (F.floor(F.col("id") / 4) * 0.5 - 1).alias("y"))
    n = 60
    points = cells.crossJoin(spark.range(n * n).withColumnRenamed("id", "k"))
    at = (F.col("x") + (F.col("k") % n + 0.5) / n * 0.5, F.col("y") + (F.floor(F.col("k") / n) + 0.5) / n * 0.5)
    sampled = {r["id"]: r["s"] for r in points.groupBy("id").agg(F.avg(geom.in_polygons(*at, [star]).cast("double")).alias("s")).collect()}
    exact = {r["id"]: r["s"] for r in cells.select("id", clip.square_share(F.col("x"), F.col("y"), F.lit(0.5), [star]).alias("s")).collect()}
    assert all(abs(exact[i] - sampled[i]) < 0.02 for i in exact)


def test_clipped_lines(spark):
    lines = {"across": [(-1, 3), (5, 3)], "over the hole": [(-1, 1.5), (5, 1.5)], "inside": [(2.5, 2.5), (3.5, 2.5)], "outside": [(6, 6), (7, 7)], "in and out": [(3, 3), (6, 3), (3, 3.5)], "point": [(1, 1)]}
    df = spark.createDataFrame([(k, 0, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in lines.items()], "id string, kind int, points array<struct<x:double,y:double>>")
    got = {r["id"]: r["metres"] for r in clip.clipped_lines(df, [SQUARE]).collect()}
    degree = lambda y: math.pi / 180 * 6371008.8 * math.cos(math.radians(y))
    assert set(got) == {"across", "over the hole", "inside", "in and out"}
    assert abs(got["across"] / degree(3) - 4) < 1e-3 and abs(got["over the hole"] / degree(1.5) - 3) < 1e-3 and abs(got["inside"] / degree(2.5) - 1) < 1e-3
    assert abs(got["in and out"] / degree(3) - 1 - math.hypot(1, 1 / 6)) < 5e-3


def test_lines_that_touch_corners_and_batches_of_segments(spark, monkeypatch):
    diamond = [[(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]]
    lines = {"left": [(-1, -3), (-1, 3)], "right": [(1, -3), (1, 3)], "low": [(-3, -1), (3, -1)], "high": [(-3, 1), (3, 1)], "through": [(-3, 0), (3, 0)]}
    df = spark.createDataFrame([(k, 0, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in lines.items()], "id string, kind int, points array<struct<x:double,y:double>>")
    assert {r["id"] for r in clip.clipped_lines(df, [diamond]).collect()} == {"through"}

    rng = random.Random(3)
    shapes = [[[(rng.uniform(2, 4) * math.cos(i / 100 * math.pi), rng.uniform(2, 4) * math.sin(i / 100 * math.pi)) for i in range(200)], SQUARE[1]], [[(5.0, 0.0), (6.0, 0.0), (6.0, 6.0)]]]
    ends = [[rng.uniform(-6, 6) for _ in range(4)] for _ in range(60)]
    want = []
    for ax, ay, bx, by in ends:  # by sampling
        n, inside = 4000, 0
        for i in range(n):
            x, y = ax + (bx - ax) * (i + 0.5) / n, ay + (by - ay) * (i + 0.5) / n
            odd = [[sum((y2 > y) != (y1 > y) and x < (y - y2) * (x1 - x2) / (y1 - y2) + x2 for x1, y1, x2, y2 in geom.edges(ring)) % 2 for ring in shape] for shape in shapes]
            inside += any(o[0] and not any(o[1:]) for o in odd)
        want.append(inside / n)
    columns = np.asarray(ends).T
    whole = geom.haversine_np(*columns)
    for crossed in (1, 1000, 1 << 16):
        monkeypatch.setattr(clip, "CROSSED", crossed)
        got = np.nan_to_num(clip.inside_metres(shapes, *columns))
        assert np.allclose(got / whole, want, atol=0.02)
    assert len(clip.inside_metres(shapes, *np.empty((4, 0)))) == 0


def test_circle(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 0.0), (2, -1.0), (3, 200.5), (4, None)], "id int, km double")
    rows = {r["id"]: r["ring"] for r in df.select("id", geom.circle(F.lit(2.0), F.lit(60.0), F.col("km")).alias("ring")).collect()}
    assert len(rows[0]) == 48 and all(rows[i] is None for i in (1, 2, 3, 4))
    assert all(abs(math.hypot((p["x"] - 2) * 0.5, p["y"] - 60) * 111.32 - 5) < 1e-9 for p in rows[0])


def test_rate_decisions_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else rng.choice([1, 1, 1, 2, 3]), 1_700_000_000 + rng.randrange(900)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    want = []
    for key in (None, 1, 2, 3):
        kept = []
        for s, i in sorted((s, i) for i, k, s in rows if k == key):
            recent = [t for t in kept if s - t <= 60]
            if len(recent) < 4:
                kept.append(s)
                want.append((i, key, True, 3 - len(recent), 0))
            else:
                want.append((i, key, False, 0, max(1, int(61 - (s - min(recent))))))
    assert sorted(map(tuple, store.rate_decisions(events, 4).collect())) == sorted(want)
    assert any(not w[2] for w in want)
    assert {tuple(r)[2:] for r in store.rate_decisions(events, 0).collect()} == {(True, -1, 0)}
    assert store.rate_decisions(events.filter("false"), 4).count() == 0


def test_ingest_counts_rows_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k) for k in range(4)], "k long, v long").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    table, ledger = usage.ingested(stream, "k", "v")
    assert sorted(map(tuple, table.collect())) == [(k, 20 + k) for k in range(4)]
    assert sorted(r["rows"] for r in ledger.collect()) == [4, 4, 4]


def test_bands_of_cells_need_no_shuffle(spark):
    cells = spark.createDataFrame([("a", 10.0, 1.895, 41.595, 0.01), ("b", 10.0, 9.0, 9.0, 0.01)], "cell_id string, population double, x0 double, y0 double, size double")
    out = clip.cells_in_bands(cells, fx.BANDS)
    assert sorted((r["cell_id"], r["band_index"], round(r["share"], 9)) for r in out.collect()) == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_exclusive_shares_of_overlapping_bands(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    diamond = [(0.5, 0.5), (1.0, 0.0), (1.5, 0.5), (1.0, 1.0)]
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]  # two triangles that meet in the middle
    cells = spark.createDataFrame([("all", 0.0, 0.0, 2.0, 1.0), ("part", 0.5, 0.25, 0.5, 1.0), ("far", 7.0, 7.0, 1.0, 1.0)], "cell_id string, x0 double, y0 double, size double, population double")

    def got(*shapes):
        bands = [(str(i), None, shape) for i, shape in enumerate(shapes)]
        return {(r.cell_id, r.band_index): round(r.share, 9) for r in clip.exclusive_shares(cells, bands).collect()}

    assert got([[box(0, 0, 1, 1)]], [[diamond]]) == {("all", 0): 0.25, ("all", 1): 0.0625, ("part", 0): 1.0}
    assert got([[diamond]], [[box(0, 0, 1, 1)]]) == {("all", 0): 0.125, ("all", 1): 0.1875, ("part", 0): 0.75, ("part", 1): 0.25}
    # polygons of one band that overlap count once, holes that a later band fills count there
    assert got([[box(0, 0, 1, 1)], [box(0.5, 0, 1.5, 1)]]) == {("all", 0): 0.375, ("part", 0): 1.0}
    assert got([[box(0, 0, 2, 2), box(0.5, 0.5, 1.5, 1.5)]], [[box(0, 0, 1, 1)]]) == {("all", 0): 0.75, ("all", 1): 0.0625, ("part", 0): 0.5, ("part", 1): 0.5}
    assert got([[bow]]) == {("all", 0): 0.125, ("part", 0): 0.75}


def test_lines_as_vertices_equal_lines_as_points(spark):
    rng = random.Random(8)
    lines = [(i, i % 2, [{"x": rng.uniform(-1, 5), "y": rng.uniform(-1, 5)} for _ in range(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(lines, "id long, kind int, points array<struct<x:double,y:double>>")
    vertices = df.select("id", "kind", F.posexplode("points").alias("seq", "p")).select("id", "kind", "seq", "p.x", "p.y").orderBy(F.rand(1))
    want = {(r["id"], r["kind"]): r["metres"] for r in clip.clipped_lines(df, [SQUARE]).collect()}
    got = {(r["id"], r["kind"]): r["metres"] for r in clip.clipped_lines(vertices, [SQUARE]).collect()}
    assert set(got) == set(want) and len(want) > 10 and all(abs(got[k] - m) < 1e-6 for k, m in want.items())
