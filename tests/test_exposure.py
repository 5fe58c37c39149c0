"""Operators against small literals, and the registered queries' shape."""

from pyspark.sql import functions as F

from atrisk.functions import geom, taxonomy
from atrisk.operators import exposure, store
from atrisk.plans import registry

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]


def test_point_in_polygon_with_hole(spark):
    df = spark.createDataFrame([(0.5, 0.5, True), (1.5, 1.5, False), (5.0, 1.0, False), (3.0, 3.0, True)], "x double, y double, want boolean")
    assert df.filter(geom.in_polygons(F.col("x"), F.col("y"), [SQUARE]) != F.col("want")).count() == 0


def test_earliest_band_wins_and_null_outside(spark):
    bands = [("1h", 60.0, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]]), ("3h", 180.0, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]])]
    df = spark.createDataFrame([("a", 0.5, 0.5), ("b", 3.0, 3.0), ("c", 9.0, 9.0)], "id string, lon double, lat double")
    got = {r["id"]: (r["band_index"], r["band"], r["minutes"]) for r in exposure.earliest_band(df, bands).collect()}
    assert got == {"a": (0, "1h", 60.0), "b": (1, "3h", 180.0), "c": (None, None, None)}


def test_distance_to_front(spark):
    df = spark.createDataFrame([(0.0, 0.01)], "lon double, lat double")
    line = [("x", None, [[[(0.0, 0.0), (1.0, 0.0), (1.0, -1.0)]]])]
    assert abs(exposure.distance_to_front(df, line).first()["distance_m"] - 1113.2) < 1e-6


def test_layers():
    assert exposure.resolve_layers(["campsite"]) == ["tourism"]
    assert exposure.resolve_layers(["nothing"]) is None and exposure.resolve_layers(["all", "water"]) is None


def test_taxonomy_is_complete():
    rows = taxonomy.rows()
    assert len({r[1] for r in rows}) == len(rows) and "other" in {r[1] for r in rows}
    assert set(taxonomy.HAZARDOUS) | set(taxonomy.RESPONSE) <= {r[1] for r in rows}


def test_upsert_first_in_batch_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    batch = spark.createDataFrame([("b", 3, 2), ("b", 2, 1), ("c", 4, 3)], "id string, v int, pos int")
    assert sorted(map(tuple, store.upsert(base, batch, "id", "pos").collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_tile_states(spark):
    ledger = spark.sql("""select * from values ('t1', timestamp'2024-01-20 00:00:00', 'ok', 1), ('t2', timestamp'2024-01-30 23:50:00', 'error', 2), ('t3', timestamp'2023-01-01 00:00:00', 'ok', 3), ('t1', timestamp'2023-01-20 00:00:00', 'error', 4) as t(tile_key, fetched_at, status, event_id)""")
    got = {r["tile_key"]: r["state"] for r in store.tile_states(ledger, F.lit("2024-01-31 00:00:00").cast("timestamp")).collect()}
    assert got == {"t1": "fresh", "t2": "failed", "t3": "stale"}


def test_every_query_is_registered_with_an_oracle():
    assert registry.FLAGSHIP in registry.queries()
    beyond_sql = {"e2_pair_scores", "e3_matches", "e4_clusters", "e5_merged_records", "e7_near_miss_hints", "e8_conflation_stats", "x2_rate_decisions"}
    assert set(registry.oracle_sql()) == set(registry.queries()) - beyond_sql


def test_perimeter_includes_its_boundary(spark):
    bands = [("b", 1.0, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]])]
    points = {"left": (0.0, 2.0), "right": (4.0, 2.0), "top": (2.0, 4.0), "bottom": (2.0, 0.0), "corner": (4.0, 4.0), "hole's edge": (1.0, 2.0), "in": (0.5, 0.5), "in hole": (2.0, 2.0), "out": (4.5, 2.0), "beside": (2.0, 4.1)}
    assets = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, lon double, lat double")
    assert {r["id"] for r in exposure.in_perimeter(assets, bands).collect()} == set(points) - {"in hole", "out", "beside"}


def _circle(n: int, closed: bool):
    import math

    ring = [(2.0 + 0.5 * math.cos(2 * math.pi * i / n), 42.0 + 0.5 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return ring + ring[:1] if closed else ring


def test_perimeters_of_thousands_of_vertices(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.uniform(1.3, 2.7), rng.uniform(41.3, 42.7), "hospital") for i in range(200)]
    assets = spark.createDataFrame(rows, "id int, lon double, lat double, subcategory string")
    got = {}
    for n, closed in ((20, False), (20, True), (4000, True)):
        bands = [("b", 60.0, [[_circle(n, closed)]])]
        at = exposure.distance_to_front(exposure.earliest_band(exposure.in_perimeter(exposure.with_class(assets), bands), bands), bands)
        got[n, closed] = {r["id"]: (r["band_index"], round(r["distance_m"], 3)) for r in at.collect()}
    assert got[20, False] == got[20, True]
    inside = {i for i, x, y, _ in rows if (x - 2) ** 2 + (y - 42) ** 2 < 0.2499}
    outside = {i for i, x, y, _ in rows if (x - 2) ** 2 + (y - 42) ** 2 > 0.2501}
    assert inside <= set(got[4000, True]) and not outside & set(got[4000, True])


def test_many_edges_agree_with_few(spark, monkeypatch):
    points = spark.range(1600).selectExpr("(id % 40 - 2) / 8D as x", "(id div 40 - 2) / 8D as y")
    columns = lambda: [geom.in_polygons(F.col("x"), F.col("y"), [SQUARE]).alias("i"), geom.on_edges(F.col("x"), F.col("y"), [SQUARE]).alias("o"), geom.distance_m(F.col("x"), F.col("y"), [SQUARE]).alias("d")]
    few = points.select("x", "y", *columns()).collect()
    monkeypatch.setattr(geom, "UNROLLED", 0)
    assert points.select("x", "y", *columns()).collect() == few


def test_metric_buffer(spark):
    df = spark.createDataFrame([(2.0, 2.0, True), (4.0005, 2.0, True), (4.01, 2.0, False), (1.5, 1.5, False)], "x double, y double, want boolean")
    assert df.filter(geom.within_m(F.col("x"), F.col("y"), [SQUARE], 100.0) != F.col("want")).count() == 0
