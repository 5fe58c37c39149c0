"""Census grids on the equal-area projection of Europe, as columns.

The inverse of Lambert's azimuthal equal-area projection on the GRS80 ellipsoid (Snyder,
Map Projections: A Working Manual, equations 3-12 to 3-18 and 24-17 to 24-30).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, and the projection's centre and false origin.
A, E2 = 6378137.0, (2 - 1 / 298.257222101) / 298.257222101
LAT0, LON0, EAST0, NORTH0 = 52.0, 10.0, 4_321_000.0, 3_210_000.0
GRID_ID = r"(?i)(?:([0-9]+)km)?N([0-9]+)E([0-9]+)"


def constants() -> dict[str, float]:
    """What the projection's centre fixes: authalic latitude, radius and scale."""
    e, s = math.sqrt(E2), math.sin(math.radians(LAT0))
    q = lambda v: (1 - E2) * (v / (1 - E2 * v * v) + math.atanh(e * v) / e)
    beta, radius = math.asin(q(s) / q(1.0)), A * math.sqrt(q(1.0) / 2)
    scale = A * math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * s * s) / (radius * math.cos(beta))
    return {"sin0": math.sin(beta), "cos0": math.cos(beta), "radius": radius, "scale": scale}


def series() -> tuple[float, float, float]:
    """From authalic to geodetic latitude: the factors of sin 2b, 4b and 6b."""
    return E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360


def lonlat(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Degrees of a projected point."""
    k = constants()
    x, y = (easting - EAST0) / k["scale"], (northing - NORTH0) * k["scale"]
    rho = F.hypot(x, y)
    c = 2 * F.asin(rho / (2 * k["radius"]))
    # sin(c) / rho, and its limit at the centre
    ratio = F.coalesce(F.sin(c) / F.nullif(rho, F.lit(0.0)), F.lit(1 / k["radius"]))
    beta = F.asin(F.cos(c) * k["sin0"] + y * ratio * k["cos0"])
    a, b, d = series()
    lat = beta + F.sin(2 * beta) * a + F.sin(4 * beta) * b + F.sin(6 * beta) * d
    lon = F.atan2(x * ratio, F.cos(c) * k["cos0"] - y * ratio * k["sin0"])
    return F.degrees(lon) + LON0, F.degrees(lat)


def corner(grid_id: Column) -> dict[str, Column]:
    """``easting, northing, size`` in metres of ids such as 1kmN2689E4337; null for others."""
    part = lambda i: F.regexp_extract(grid_id, GRID_ID, i).try_cast("double") * 1000
    return {"easting": part(3), "northing": part(2), "size": F.when(part(2).isNotNull(), F.coalesce(part(1), F.lit(1000.0)))}


def cell_wkt(easting: Column, northing: Column, size: Column) -> Column:
    """The cell's outline, each corner projected on its own, to seven decimals."""
    ends = [(easting, northing), (easting + size, northing), (easting + size, northing + size), (easting, northing + size)]
    points = [F.format_string("%.7f %.7f", *lonlat(e, n)) for e, n in ends]
    return F.when(easting.isNotNull(), F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *points, points[0]), F.lit("))")))
