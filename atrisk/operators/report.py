"""The whole exposure report: assets are filtered, merged, located, valued and scored once and
written; every part of the report reads the columns that it needs from that table."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrisk.functions import geom
from atrisk.operators import clip, exposure, landed, merge, reports, resolve
from atrisk.operators.shared import dealt, written

Bands = exposure.Bands

#: Columns of assets that a merged record fills from others, by the name that merging gives them.
FILLED = {"cap_people": "people", "cap_beds": "beds", "cap_students": "students", "cap_places": "places", "animals": "animals", "livestock_units": "livestock_units"}
# The ellipsoid of WGS 84.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


@dataclasses.dataclass(frozen=True)
class Report:
    """The parts, each a DataFrame over the same written tables; networks and cells may be absent."""

    summary: DataFrame
    bands: DataFrame
    categories: DataFrame
    page: DataFrame
    top: DataFrame
    warnings: DataFrame
    networks: DataFrame | None
    cells: DataFrame | None


def area_km2(polygons: list[geom.Polygon], pieces: int = 16) -> float:
    """Area on the ellipsoid of polygons with holes that don't overlap, edges being straight in
    degrees: the sum over edges of the strip between edge and equator."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def strip(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)

    def ring_area(ring) -> float:
        total = 0.0
        for x1, y1, x2, y2 in geom.edges(ring):
            total += math.radians(x2 - x1) / pieces * sum(strip(y1 + (y2 - y1) * (i + 0.5) / pieces) for i in range(pieces))
        return abs(total) * SEMI_MAJOR**2 / 2e6

    return sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in polygons)


def inventory(assets: DataFrame, bands: Bands, layers: list[str]) -> DataFrame:
    """Assets of the wanted layers in the perimeter, with their band_index."""
    categories = exposure.resolve_layers(layers)
    wanted = assets if categories is None else assets.filter(F.col("category").isin(categories))
    return exposure.in_perimeter(wanted, bands, keep_band=True)


def conflated(assets: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Assets (with a numeric doc_id) of which those that are one thing have become one row, the
    first by source priority with its gaps filled, and merged_count.

    Only rows in a match are merged; all others pass as they are. A merged row stands where
    its first record does, so that its band_index holds."""
    members = written(resolve.linked(assets, matches_only=True)[1], "report-members")
    alone = assets.join(members, "doc_id", "left_anti").withColumn("merged_count", F.lit(1).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    have = lambda name, kind: F.col(name) if name in assets.columns else none(kind)
    text = F.create_map(F.lit("province"), F.col("province"))
    records = assets.select(
        "*", *(F.col(c).alias(n) for c, n in FILLED.items() if c != n), none("double").alias("dwellings"), have("website", "string").alias("__website"), have("operator", "string").alias("__operator"), text.alias("address"), none("map<string,string>").alias("attributes"), *(have(c, "array<string>").alias(f"__{c}") for c in merge.LISTS), none("string").alias("basis")
    )
    spare = [c for c in ("website", "operator", *merge.LISTS) if c in assets.columns]
    records = records.drop(*spare).withColumnsRenamed({f"__{c}": c for c in ("website", "operator", *merge.LISTS)})
    merged = {"doc_id", "source_id", "source_ref", "category", "lon", "lat", "confidence", "geometry_kind", "province", *merge.SINGLE.values(), *merge.LISTS, *FILLED}
    whole = merge.merged_records(records, members, priority, [c for c in assets.columns if c not in merged])[0]
    names = {c: F.col(FILLED.get(c, c)) for c in assets.columns} | {"province": F.col("address")["province"]}
    together = whole.select(*(names[c].cast(assets.schema[c].dataType).alias(c) for c in assets.columns), "merged_count")
    return alone.unionByName(together)


def scored(assets: DataFrame, bands: Bands, priority: dict[str, int] | None, layers: list[str]) -> DataFrame:
    """The table that the parts read: every thing in the perimeter with band, distance, value,
    occupancy and score. ``priority`` of sources, or None for no conflation."""
    found = inventory(dealt(assets, "id"), bands, layers)  # a small file's one split would locate and write them all
    if priority is not None:
        found = conflated(written(found, "report-inventory"), priority)
    else:
        found = found.withColumn("merged_count", F.lit(1).cast("long"))
    return written(exposure.scored(found, bands), "report-scored")


def residents(cells: DataFrame, bands: Bands) -> DataFrame:
    """``cell_id, population, band_index, share``, written: ground counts once, for its first band."""
    return written(clip.exclusive_shares(cells, bands), "report-shares")


def band_parts(table: DataFrame, bands: Bands, shares: DataFrame | None = None) -> DataFrame:
    """One row per band, also of those without an asset, with counts and values by category
    as maps, of which there are no more entries than categories."""
    spark = table.sparkSession
    flag = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    each = table.filter("band_index is not null").groupBy("band_index", "category").agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur"), flag("critical"), flag("hazardous"))
    entries = lambda value, test=F.lit(True): F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.struct("category", value)))))
    sums = ["assets", "people", "value_eur", "critical", "hazardous"]
    value = F.round("value_eur", 2).alias("value_eur")
    maps = each.groupBy("band_index").agg(*(F.sum(c).alias(c) for c in sums), entries("assets").alias("by_category"), entries(value, F.col("value_eur") != 0).alias("value_by_category"))
    rows = [(i, label, minutes, area_km2(polygons)) for i, (label, minutes, polygons) in enumerate(bands)]
    out = spark.createDataFrame(rows, "band_index int, band string, minutes double, area_km2 double").join(maps, "band_index", "left")
    if shares is None:
        out = out.withColumn("residents", F.lit(0.0))
    else:
        people = shares.filter("band_index is not null").groupBy("band_index").agg(F.sum(F.col("population") * F.col("share")).alias("residents"))
        out = out.join(people, "band_index", "left")
    nothing = {c: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>")) for c, kind in (("by_category", "bigint"), ("value_by_category", "double"))}
    filled = {c: F.coalesce(c, F.lit(0)) for c in (*sums, "residents")} | {c: F.coalesce(c, empty) for c, empty in nothing.items()}
    return out.withColumns(filled)


def category_parts(table: DataFrame) -> DataFrame:
    """Per category its things, people, value and whether people are borne, greatest value first."""
    return table.groupBy("category").agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur"), F.bool_or("human").alias("human")).orderBy(F.desc("value_eur"), "category")


def order_by(sort_by: str) -> list[Column]:
    orders = {"priority": [F.desc("priority")], "value": [F.desc("total_eur")], "distance": [F.asc_nulls_last("distance_m")]}
    return orders.get(sort_by, [F.asc_nulls_first("category"), F.asc_nulls_first("subcategory"), F.coalesce("name", F.lit(""))])


def page(table: DataFrame, sort_by: str, most: int) -> DataFrame:
    """The first ``most`` things with their position, and whether there are more; ties go by id.
    One more row than asked for is sorted, which tells of the rest."""
    order = [*order_by(sort_by), F.col("id")]
    first = table.orderBy(*order).limit(most + 1)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # of the page alone
    return numbered.withColumn("truncated", F.max("position").over(Window.partitionBy()) > most).filter(F.col("position") <= most)


def cell_list(cells: DataFrame, shares: DataFrame, bands: Bands, most: int) -> DataFrame:
    """The densest ``most`` cells that bands reach: share and people inside, the band of their
    middle, and whether there are more."""
    inside = shares.filter("band_index is not null").groupBy("cell_id").agg(F.least(F.sum("share"), F.lit(1.0)).alias("share"))
    middle = cells.select("cell_id", "population", (F.col("x0") + F.col("size") / 2).alias("lon"), (F.col("y0") + F.col("size") / 2).alias("lat"))
    reached = middle.join(inside, "cell_id")
    n = inside.agg(F.count("*")).scalar()
    first = reached.orderBy(F.desc("population"), "cell_id").limit(most)
    return exposure.earliest_band(first, bands).select("cell_id", "population", "share", (F.col("population") * F.col("share")).alias("people"), "band_index", (n > most).alias("truncated"))


def network_parts(lines: DataFrame, bands: Bands) -> DataFrame:
    """Kilometres and number of lines by kind within the union of the bands."""
    inside = clip.clipped_lines(lines, [p for *_, polygons in bands for p in polygons])
    return inside.groupBy("kind").agg((F.sum("metres") / 1000).alias("km"), F.count("id").alias("lines"))  # a kind's ids are distinct there


def regime(bands: Bands, regional: reports.Box, national: reports.Box) -> str:
    """How deep the data is where all bands are: in the region, the country or neither."""
    x0, y0, x1, y1 = geom.envelope([p for *_, polygons in bands for p in polygons])
    within = lambda b: b[0] <= x0 and b[1] <= y0 and x1 <= b[2] and y1 <= b[3]
    return "regional" if within(regional) else "national" if within(national) else "open map only"


def totals(table: DataFrame, bands: Bands, shares: DataFrame | None, coverage: str) -> DataFrame:
    """One row over all things, before any page is cut."""
    sums = exposure.summary(table)
    merged = table.agg(F.coalesce(F.sum(F.col("merged_count") - 1), F.lit(0))).scalar()
    inside = F.lit(0.0) if shares is None else shares.filter("band_index is not null").agg(F.coalesce(F.sum(F.col("population") * F.col("share")), F.lit(0.0))).scalar()
    return sums.withColumns({"merged": merged, "residents": inside, "area_km2": F.lit(sum(area_km2(p) for *_, p in bands)), "coverage": F.lit(coverage)})


def said(summary: DataFrame, cells: DataFrame | None, shares: DataFrame | None, most_assets: int, most_cells: int) -> DataFrame:
    """Warnings, of which none is made up: each states figures of the report's own tables."""
    text = lambda *parts: F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))
    n_cells = F.lit(None).cast("long") if shares is None else shares.filter("band_index is not null").agg(F.countDistinct("cell_id")).scalar()
    facts = summary.select("asset_count", "merged", "coverage", n_cells.alias("cells"))
    return landed.warnings(facts, {
        "capped": (F.col("asset_count") > most_assets, text(f"the list ends after {most_assets} of ", "$asset_count", " assets; totals count all")),
        "merged": (F.col("merged") > 0, text("$merged", " records merged into ", "$asset_count", " distinct assets")),
        "cells": (F.col("cells") > most_cells, text(f"the {most_cells} densest of ", "$cells", " cells are listed; totals count all")),
        "no grid": (F.col("cells") == 0, F.lit("no population grid covers this area")),
        "coverage": (F.col("coverage") == "open map only", F.lit("no registry covers this area")),
    })


def build(
    assets: DataFrame, bands: Bands, *, cells: DataFrame | None = None, lines: DataFrame | None = None, layers: list[str] | None = None, priority: dict[str, int] | None = None,
    sort_by: str = "priority", max_assets: int = 5000, max_cells: int = 5000, regional: reports.Box = (-180.0, -90.0, 180.0, 90.0), national: reports.Box = (-180.0, -90.0, 180.0, 90.0),
) -> Report:
    """The report on ``assets`` in time-banded perimeters, with residents of ``cells`` (cell_id,
    population, x0, y0, size) and ``lines`` (as in :func:`clip.clipped_lines`) where they are given. Empty tables
    give zero totals, every band, and no other rows."""
    table = scored(assets, bands, priority, layers or ["all"])
    shares = None if cells is None else residents(cells, bands)
    summary = totals(table, bands, shares, regime(bands, regional, national))
    listed = None if cells is None else cell_list(cells, shares, bands, max_cells)
    return Report(
        summary=summary, bands=band_parts(table, bands, shares), categories=category_parts(table), page=page(table, sort_by, max_assets), top=page(table, "priority", 10).drop("truncated"),
        warnings=said(summary, listed, shares, max_assets, max_cells), networks=None if lines is None else network_parts(lines, bands), cells=listed,
    )


def population_report(cells: DataFrame, bands: Bands, max_cells: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Residents by band and the list of cells, without any work on assets."""
    shares = residents(cells, bands)
    people = shares.filter("band_index is not null").groupBy("band_index").agg(F.sum(F.col("population") * F.col("share")).alias("residents"), F.count("*").alias("cells"))
    return people, cell_list(cells, shares, bands, max_cells)
