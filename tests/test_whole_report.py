"""The whole report on small literals and on twice registered assets."""

import math

from pyspark.sql import functions as F

from atrisk.operators import report
from atrisk.plans.whole_report_queries import BANDS
from atrisk.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_area_on_the_ellipsoid():
    square = [[(2.0, 41.0), (2.1, 41.0), (2.1, 41.1), (2.0, 41.1)]]
    e2 = report.FLATTENING * (2 - report.FLATTENING)
    s = math.sin(math.radians(41.05))
    across = report.SEMI_MAJOR / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(41.05)) * math.radians(0.1)
    up = report.SEMI_MAJOR * (1 - e2) / (1 - e2 * s * s) ** 1.5 * math.radians(0.1)
    assert abs(report.area_km2([square]) / (across * up / 1e6) - 1) < 1e-6
    hole = [*square, [(2.02, 41.02), (2.02, 41.04), (2.04, 41.04), (2.04, 41.02)]]
    assert abs((report.area_km2([square]) - report.area_km2([hole])) / report.area_km2([[hole[1]]]) - 1) < 1e-9
    whole = [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]]
    assert abs(report.area_km2([whole], 20_000) / 510_065_621.7 - 1) < 1e-6


def _assets(spark):
    base = fx.assets(spark, SF).withColumn("doc_id", F.col("source_ref"))
    one = base.filter("source_ref = 3").withColumns({"lon": F.lit(1.9), "lat": F.lit(41.6), "source_id": F.lit("osm"), "name": F.lit("Escola Sant Jordi"), "confidence": F.lit(0.6), "floors": F.lit(2.0), "footprint_m2": F.lit(350.0), "cap_beds": F.lit(None).cast("double")})
    two = one.withColumns({"doc_id": F.lit(1000), "id": F.lit("x1000"), "source_ref": F.lit(1000), "source_id": F.lit("es.cat.schools"), "name": F.lit("ESCOLA SANT JORDI, S.L."), "lon": F.lit(1.9002), "confidence": F.lit(0.8), "floors": F.lit(None).cast("double"), "footprint_m2": F.lit(0.0), "cap_beds": F.lit(40.0)})
    far = one.withColumns({"doc_id": F.lit(1001), "id": F.lit("x1001"), "source_ref": F.lit(1001), "lon": F.lit(1.95)})
    off = one.withColumns({"doc_id": F.lit(1002), "id": F.lit("x1002"), "source_ref": F.lit(1002), "lon": F.lit(9.0)})
    return one.unionByName(two).unionByName(far).unionByName(off)


def test_one_thing_counts_once_and_has_both_sources_figures(spark):
    r = report.build(_assets(spark), BANDS, priority=fx.SOURCES, max_assets=1)
    total = r.summary.first()
    assert (total["asset_count"], total["merged"], total["residents"]) == (2, 1, 0.0)
    rows = {x["id"]: x for x in report.page(report.scored(_assets(spark), BANDS, fx.SOURCES, ["all"]), "distance", 10).collect()}
    assert set(rows) == {"x1000", "x1001"}
    both = rows["x1000"]
    assert (both["merged_count"], both["floors"], both["footprint_m2"], both["cap_beds"], both["band_index"], both["name"]) == (2, 2.0, 350.0, 40.0, 0, "ESCOLA SANT JORDI, S.L.")
    assert abs(both["confidence"] - 0.86) < 1e-9 and not both["truncated"]
    assert [(x["position"], x["truncated"]) for x in r.page.collect()] == [(1, True)]
    assert [x["code"] for x in r.warnings.orderBy("position").collect()] == ["capped", "merged"]
    bands = {b["band"]: b for b in r.bands.collect()}
    assert set(bands) == {"1h", "3h", "6h"} and bands["1h"]["assets"] == 2 and bands["6h"]["by_category"] == {} and bands["6h"]["people"] == 0
    assert sum(bands["1h"]["by_category"].values()) == 2 and bands["1h"]["area_km2"] > 100
    assert sum(c["value_eur"] for c in r.categories.collect()) == total["value_eur"]


def test_without_conflation_and_of_other_layers(spark):
    assets = _assets(spark)
    assert report.build(assets, BANDS).summary.first()["asset_count"] == 3
    category = assets.first()["category"]
    other = "water" if category != "water" else "tourism"
    r = report.build(assets, BANDS, layers=[other], priority=fx.SOURCES, cells=fx.pop_grid(spark, SF).limit(0))
    assert r.summary.first()["asset_count"] == 0 and r.page.count() == r.top.count() == r.categories.count() == r.cells.count() == 0
    assert [b["assets"] for b in r.bands.orderBy("band_index").collect()] == [0, 0, 0]
    assert [w["code"] for w in r.warnings.collect()] == ["no grid"]


def test_cells_and_coverage(spark):
    cells = spark.createDataFrame([("in", 10.0, 1.9, 41.6, 0.01), ("dense", 50.0, 1.91, 41.6, 0.01), ("out", 90.0, 5.0, 41.6, 0.01)], "cell_id string, population double, x0 double, y0 double, size double")
    people, listed = report.population_report(cells, BANDS, 1)
    assert [(round(x["residents"], 6), x["band_index"]) for x in people.collect()] == [(60.0, 0)]
    assert [(x["cell_id"], round(x["share"], 9), x["band_index"], x["truncated"]) for x in listed.collect()] == [("dense", 1.0, 0, True)]
    near, wide = (1.0, 41.0, 3.0, 42.0), (0.0, 40.0, 4.0, 43.0)
    assert [report.regime(BANDS, near, wide), report.regime(BANDS, (1.8, 41.0, 3.0, 42.0), wide), report.regime(BANDS, near[:1] * 4, near[:1] * 4)] == ["regional", "national", "open map only"]


def test_twice_registered_assets_collapse(spark):
    """What the copies add is merged again: the things are those of the first registration."""
    once = report.inventory(fx.assets(spark, SF), BANDS, ["all"])
    both = report.inventory(fx.twice_registered(fx.assets(spark, SF)), BANDS, ["all"])
    got = report.conflated(both, fx.SOURCES)
    assert both.count() > once.count()
    ref = lambda df: sorted(r["source_ref"] for r in df.select(F.col("source_ref").cast("long").alias("source_ref")).collect())
    assert ref(got) == ref(once) and got.agg(F.sum("merged_count")).first()[0] == both.count()
