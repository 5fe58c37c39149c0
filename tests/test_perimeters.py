"""GeoJSON perimeters, and what they select."""

import pytest

from atrisk.operators import exposure
from atrisk.sources import perimeters


def square(x, y, size, closed=True):
    ring = [[x, y], [x + size, y], [x + size, y + size], [x, y + size]]
    return ring + ring[:1] if closed else ring


def feature(ring, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_bands_go_by_minutes_unknown_last():
    given = [feature(square(0, 0, 3), band="later"), feature(square(0, 0, 2), label="0-3h"), feature(square(0, 0, 1), name="front", t_minutes=30), {"type": "Feature", "geometry": None}, feature(square(0, 0, 9), hours=1.5)]
    bands, notes = perimeters.parse({"type": "FeatureCollection", "features": given})
    assert [(b[0], b[1]) for b in bands] == [("front", 30.0), ("band_4", 90.0), ("0-3h", 180.0), ("later", None)] and notes == []


def test_bands_go_by_area_without_minutes():
    bands, _ = perimeters.parse({"type": "FeatureCollection", "features": [feature(square(0, 0, 3), band="big"), feature(square(0, 0, 1), band="small")]})
    assert [b[0] for b in bands] == ["small", "big"]


@pytest.mark.parametrize("label, want", [("t+90min", 90.0), ("6h", 360.0), ("1.5 h", 90.0), ("45 m", 45.0), ("area", None)])
def test_minutes_of_labels(label, want):
    assert perimeters.minutes_of({}, label) == want


def test_open_rings_are_noted():
    bands, notes = perimeters.parse({"type": "MultiPolygon", "coordinates": [[square(0, 0, 1, closed=False)], [square(2, 2, 1)]]})
    assert len(bands[0][2]) == 2 and len(notes) == 1


@pytest.mark.parametrize("given", [None, {}, {"type": "Point", "coordinates": [1, 2]}, {"type": "FeatureCollection", "features": []}, {"type": "Feature", "geometry": None}, {"type": "Polygon", "coordinates": []}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}])
def test_what_is_no_perimeter(given):
    with pytest.raises(ValueError):
        perimeters.parse(given)


def test_parsed_bands_select_points(spark):
    with_hole = {"type": "Feature", "properties": {"band": "1h"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 4), square(1, 1, 2)]}}
    bands, _ = perimeters.parse({"type": "FeatureCollection", "features": [with_hole, feature(square(0, 0, 8), band="3h")]})
    df = spark.createDataFrame([("a", 0.5, 0.5), ("b", 2.0, 2.0), ("c", 7.0, 7.0), ("d", 9.0, 9.0)], "id string, lon double, lat double")
    assert {r["id"]: r["band"] for r in exposure.earliest_band(df, bands).collect()} == {"a": "1h", "b": "3h", "c": "3h", "d": None}


def test_census_cells(spark):
    from pyspark.sql import functions as F

    from atrisk.functions import grids

    df = spark.createDataFrame([("centre", 4_321_000.0, 3_210_000.0), ("inverse", 3_664_604.0, 2_066_000.0)], "name string, e double, n double")
    lon, lat = grids.lonlat(F.col("e"), F.col("n"))
    got = {r["name"]: (r["lon"], r["lat"]) for r in df.select("name", lon.alias("lon"), lat.alias("lat")).collect()}
    assert abs(got["centre"][0] - 10) < 1e-9 and abs(got["centre"][1] - 52) < 1e-8
    assert 1.5 < got["inverse"][0] < 2.9 and 41.0 < got["inverse"][1] < 42.0
    ids = spark.createDataFrame([("1kmN2066E3664",), ("N2066E3664",), ("2kmN2066E3664",), ("no cell",), (None,)], "id string")
    parts = [tuple(r) for r in ids.select(*(c.alias(n) for n, c in grids.corner(F.col("id")).items())).collect()]
    assert parts == [(3664e3, 2066e3, 1e3), (3664e3, 2066e3, 1e3), (3664e3, 2066e3, 2e3), (None, None, None), (None, None, None)]
    # equal area: a cell's outline on the ellipsoid covers its square kilometre
    import math

    e, n = F.lit(3664e3), F.lit(2066e3)
    ring = [tuple(map(float, p.split())) for p in spark.range(1).select(grids.cell_wkt(e, n, F.lit(1e3)).alias("w")).first()["w"][9:-2].split(", ")]
    mid = math.radians(sum(p[1] for p in ring[:4]) / 4)
    w = 1 - grids.E2 * math.sin(mid) ** 2
    metre = (math.radians(grids.A / math.sqrt(w) * math.cos(mid)), math.radians(grids.A * (1 - grids.E2) / w**1.5))
    km2 = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2 * metre[0] * metre[1] / 1e6
    assert ring[0] == ring[-1] and abs(km2 - 1) < 1e-4
