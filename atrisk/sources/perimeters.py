"""Perimeters of a request: GeoJSON to time-banded polygons.

A perimeter is a parameter of some thousand vertices at most, read where the job is set
up; its bands then become part of the plan (``functions.geom``).
"""

from __future__ import annotations

import re

from atrisk.functions import geom
from atrisk.operators.exposure import Bands

# Accepted types, and property names in the order they are tried.
TYPES = ("Polygon", "MultiPolygon", "Feature", "FeatureCollection")
MINUTES = ("minutes", "t_minutes", "eta_minutes", "offset_minutes")
HOURS = ("hours", "t_hours", "hour")


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def minutes_of(properties: dict, label: str, name: str = "minutes") -> float | None:
    """From a property in minutes or hours, else from a label such as 0-3h or t+90min."""
    for names, scale in (((name, *MINUTES), 1.0), (HOURS, 60.0)):
        for value in (_number(properties.get(n)) for n in names):
            if value is not None:
                return value * scale
    for pattern, scale in ((r"(\d+(?:\.\d+)?)\s*h", 60.0), (r"(\d+(?:\.\d+)?)\s*(?:min|m)\b", 1.0)):
        found = re.search(pattern, label, re.I)
        if found:
            return float(found[1]) * scale
    return None


def _polygons(geometry: dict, notes: list[str]) -> list[geom.Polygon]:
    kind, coordinates = geometry.get("type"), geometry.get("coordinates") or []
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"a perimeter can't be a {kind!r}; it is one of {', '.join(TYPES)}")
    out = []
    for rings in [coordinates] if kind == "Polygon" else coordinates:
        polygon = []
        for ring in rings:
            points = [(float(p[0]), float(p[1])) for p in ring]
            if len(points) < 4 or points[0] != points[-1]:
                notes.append("a ring was not closed; it was closed")
            if len(set(points)) >= 3:
                polygon.append(points)
            elif not polygon:
                break  # without its outer ring a polygon is empty
        if polygon:
            out.append(polygon)
    return out


def area(polygons: list[geom.Polygon]) -> float:
    """Square degrees, holes left out."""
    ring = lambda r: abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in geom.edges(r))) / 2
    return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in polygons)


def parse(geojson: dict, *, band_property: str = "band", minutes_property: str = "minutes") -> tuple[Bands, list[str]]:
    """Bands in order of arrival, and notes on what was mended.

    Of a FeatureCollection every feature with a geometry is a band. Bands go by minutes,
    unknown last, or by area where none has any; equal ones stay as given. What isn't a
    perimeter, or is an empty one, raises ValueError.
    """
    kind = geojson.get("type") if isinstance(geojson, dict) else None
    if kind not in TYPES:
        raise ValueError(f"a perimeter is a GeoJSON object of type {', '.join(TYPES)}")
    features = geojson.get("features") or [] if kind == "FeatureCollection" else [geojson] if kind == "Feature" else [{"geometry": geojson}]
    notes: list[str] = []
    bands: Bands = []
    for i, feature in enumerate(features):
        if not feature.get("geometry"):
            continue
        properties = feature.get("properties") or {}
        label = properties.get(band_property)
        if kind == "FeatureCollection":
            label = label or properties.get("label") or properties.get("name") or f"band_{i}"
        label = str(label or "aoi")
        polygons = _polygons(feature["geometry"], notes)
        if polygons:
            bands.append((label, minutes_of(properties, label, minutes_property), polygons))
    if not bands:
        raise ValueError("the perimeter holds no usable geometry")
    timed = any(b[1] is not None for b in bands)
    bands.sort(key=lambda b: (b[1] is None, b[1] or 0.0) if timed else area(b[2]))
    return bands, list(dict.fromkeys(notes))
