"""Footprints, tiles and perimeters as data against closed cases and plain loops."""

import random

from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.operators import overlap, perimeters
from atrisk.plans import perimeter_queries, registry
from atrisk.sources import fixtures as fx


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def shapes(spark, *rings):
    return spark.createDataFrame([(i, 0.0, 0.0, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in r] if r is not None else None) for i, r in enumerate(rings)], f"id int, lon double, lat double, rings {overlap.SHAPE}")


def test_footprints_by_what_reaches_in(spark):
    outer, hole = square(10, 10, 4), square(10, 10, 2)
    cases = {
        "centre outside, corner inside": ([square(14.5, 10, 1)], True),
        "touches an edge": ([square(15, 10, 1)], True),
        "touches a corner": ([square(15, 15, 1)], True),
        "apart": ([square(16, 10, 1)], False),
        "in the hole": ([square(10, 10, 1)], False),
        "touches the hole": ([square(11, 10, 1)], True),
        "covers all": ([square(10, 10, 9)], True),
        "ring around all, which its hole leaves out": ([square(10, 10, 9), square(10, 10, 5)], False),
        "wholly inside": ([square(13, 13, 0.5)], True),
        "a thin one across": ([[(0, 10), (20, 10), (20, 10.1), (0, 10.1)]], True),
        "closed ring": ([[*square(14.5, 10, 1), (13.5, 9)]], True),
    }
    df = shapes(spark, *(r for r, _ in cases.values()))
    got = {r.id for r in overlap.in_perimeter(df, [[outer, hole]]).collect()}
    assert got == {i for i, (_, want) in enumerate(cases.values()) if want}
    points = spark.createDataFrame([(1, 6.0, 10.0, None), (2, 5.9, 10.0, None), (3, 8.0, 8.0, []), (4, 10.0, 10.0, None), (5, None, 1.0, None)], f"id int, lon double, lat double, rings {overlap.SHAPE}")
    assert {r.id for r in overlap.in_perimeter(points, [[outer, hole]]).collect()} == {1, 3}


def test_tiles_that_a_shape_touches(spark):
    df = shapes(spark, [[(0.2, 0.2), (2.8, 0.2), (0.2, 2.8)]], [square(0.5, 0.5, 0.5)], [square(1.5, 1.5, 2.2), square(1.5, 1.5, 1.8)], None, [])
    got = {}
    for r in overlap.tiles(df, 1.0).collect():
        got.setdefault(r.id, set()).add((r.ix, r.iy))
    assert got[0] == {(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (0, 2)}  # its long side passes through (1.5, 1.5)
    assert got[1] == {(x, y) for x in (0, 1) for y in (0, 1)}
    assert got[2] == {(x, y) for x in range(-1, 4) for y in range(-1, 4)} - {(x, y) for x in range(3) for y in range(3)}
    assert set(got) == {0, 1, 2}


def test_points_are_located_as_by_each_ring_alone(spark):
    rng = random.Random(9)
    wild = [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(40)]]
    shapes_ = [[wild], [[square(5, 5, 4), square(5, 5, 1), square(2, 2, 0.5)], [square(12, 5, 1)]], *([[square(i, i, 0.7)]] for i in range(70))]
    points = [(rng.uniform(-1, 14), rng.uniform(-1, 11)) for _ in range(300)] + [(1.0, 5.0), (9.0, 9.0), (4.0, 4.5), (13.0, 6.0), *wild[0][:5]]
    x, y = F.col("x"), F.col("y")
    df = spark.createDataFrame(points, "x double, y double")
    rows = df.select("x", "y", geom.located(x, y, shapes_).alias("at")).collect()

    def odd(px, py, ring):
        return sum(((y2 > py) != (y1 > py)) and px < (py - y2) * (x1 - x2) / (y1 - y2) + x2 for x1, y1, x2, y2 in geom.edges(ring)) % 2 == 1

    for r in rows:
        want = [any(odd(r.x, r.y, p[0]) and not any(odd(r.x, r.y, h) for h in p[1:]) for p in shape) for shape in shapes_]
        assert r["at"]["inside"] == want, (r.x, r.y)
    assert [r["at"]["touches"] for r in rows[300:]] == [True] * 9


def test_versions_in_several_batches_leave_the_latest(spark, tmp_path):
    assets = perimeter_queries.valued(spark, "/root/testdata/sf0.001").select("id", "lon", "lat", "people", "total_eur")
    parts = fx.read(spark, "/root/testdata/sf0.001", "part")
    rows = perimeter_queries.derived(parts, versions=True)
    for name, keep in (("a", "version = 2"), ("b", "version = 1 and perimeter_id % 2 = 0"), ("c", "version = 1 and perimeter_id % 2 = 1")):
        rows.filter(keep).coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    newest = rows.join(rows.groupBy("perimeter_id").agg(F.max("version").alias("version")), ["perimeter_id", "version"]).drop("version")
    plain = lambda df: sorted((r.perimeter_id, r.band_index, r.assets, r.people, round(r.value_eur)) for r in df.collect())
    got = plain(perimeters.evolving(stream, assets))
    assert got and got == plain(perimeters.exposed(assets, newest))


def test_no_edge_of_a_perimeter_is_in_the_plan(spark):
    assets = spark.createDataFrame([("a", 0.5, 0.5), ("b", None, 0.5), ("c", 0.1, 0.1)], "id string, lon double, lat double")
    rows = [(7, 0, 0, 0, [{"x": x, "y": y} for x, y in square(0.512345, 0.5, 0.3)]), (7, 0, 0, 1, [{"x": x, "y": y} for x, y in square(0.5, 0.5, 0.1)]), (8, 1, 0, 0, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]), (9, 2, 3, 0, [{"x": x, "y": y} for x, y in [*square(0.5, 0.5, 0.45), (0.05, 0.05)]])]
    table = spark.createDataFrame(rows, "perimeter_id int, band_index int, part int, ring int, points array<struct<x:double,y:double>>")
    out = perimeters.first_bands(assets, table)
    assert sorted(map(tuple, out.collect())) == [(9, "a", 2), (9, "c", 2)]
    assert "512345" not in out._jdf.queryExecution().toString()
    assert perimeters.first_bands(assets, table.limit(0)).collect() == []


def test_rings_that_cross_themselves(spark):
    square_, bow = square(0.5, 0.5, 0.5), [(0, 0), (1, 1), (1, 0), (0, 1)]
    star = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]  # twice round, the inner time within
    cases = [(square_, 1.0, "not closed"), ([*square_, square_[0]], 1.0, None), (bow, 0.5, "not closed, crosses itself"), ([*bow, (0, 0)], 0.5, "crosses itself"), (star, 12.0, "not closed, crosses itself"), ([(0, 0), (1, 1)], 0.0, "not closed")]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, (r, *_) in enumerate(cases)], "id int, r array<struct<x:double,y:double>>")
    got = df.orderBy("id").select(F.round(overlap.even_odd_area(F.col("r")), 9).alias("a"), overlap.ring_note(F.col("r")).alias("n")).collect()
    assert [(r.a, r.n) for r in got] == [(a, n) for _, a, n in cases]


def test_pairs_of_perimeters_and_assets_stay_in_their_cell(spark, tmp_path):
    rng = random.Random(4)
    assets = spark.createDataFrame([(f"a{i}", rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), None if i % 3 == 0 else float(i), float(i) / 4) for i in range(400)], "id string, lon double, lat double, people double, total_eur double")
    shapes = {i: square(rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2), 0.06) for i in range(60)}
    rows = [(i, 1, 0, 0, [{"x": x, "y": y} for x, y in ring], 1) for i, ring in shapes.items()]
    table = spark.createDataFrame(rows, "perimeter_id int, band_index int, part int, ring int, points array<struct<x:double,y:double>>, version int")
    want = {}
    for a in assets.collect():
        for i, ring in shapes.items():
            if sum(((y2 > a.lat) != (y1 > a.lat)) and a.lon < (a.lat - y2) * (x1 - x2) / (y1 - y2) + x2 for x1, y1, x2, y2 in geom.edges(ring)) % 2:
                n, people, value = want.get((i, 1), (0, None, 0.0))
                want[i, 1] = (n + 1, people if a.people is None else (people or 0.0) + a.people, value + a.total_eur)
    out = perimeters.exposed(assets, table.drop("version"))
    assert {(r.perimeter_id, r.band_index): (r.assets, r.people, r.value_eur) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "CoGroup" in plan  # edges and their envelopes; never a pair
    table.write.parquet(str(tmp_path / "t"))
    late = perimeters.evolving(spark.readStream.schema(table.schema).parquet(str(tmp_path / "t")), assets)
    assert late.count() == len(want) and "Broadcast" not in late._jdf.queryExecution().executedPlan().toString()


def test_heavy_rows_of_a_small_file_are_dealt_out(spark):
    for name in ("v16_ring_repair", "n16_feature_shapes"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
