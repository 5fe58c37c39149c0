"""Exposure of assets to time-banded perimeters: bands, values, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.functions import geom, taxonomy, value

Bands = list[tuple[str, float | None, list[geom.Polygon]]]


def located(assets: DataFrame, bands: Bands) -> DataFrame:
    """Adds band_index of the first band that holds the point, else null, and touches: whether
    it lies on a boundary. Edges are gone through once a row: what the columns are made of is
    generated, so that no filter above repeats it."""
    at = geom.located(F.col("lon"), F.col("lat"), [polygons for *_, polygons in bands])
    index = lambda s: F.coalesce(*(F.when(F.get(s["inside"], F.lit(i)), i) for i in range(len(bands))))
    one = F.transform(F.array(at), lambda s: F.struct(index(s).alias("band_index"), s["touches"].alias("touches")))
    return assets.select("*", F.inline(one))


def earliest_band(assets: DataFrame, bands: Bands) -> DataFrame:
    """Adds band_index, band and minutes of the first band that holds the point, else null;
    a band_index that :func:`located` has added is taken as it is."""
    found = assets if "band_index" in assets.columns else located(assets, bands).drop("touches")
    pick = lambda values: F.when(F.col("band_index").isNotNull(), F.get(F.array(*map(F.lit, values)), F.col("band_index")))
    return found.withColumns({"band": pick([b[0] for b in bands]), "minutes": pick([b[1] for b in bands])})


def distance_to_front(assets: DataFrame, bands: Bands) -> DataFrame:
    """Adds distance_m to the boundary of the earliest band, exactly (no decimation)."""
    return assets.withColumn("distance_m", geom.distance_m(F.col("lon"), F.col("lat"), bands[0][2]))


def with_class(assets: DataFrame) -> DataFrame:
    """Joins the taxonomy by subcategory; what it doesn't know is ``other``."""
    dim = F.broadcast(taxonomy.taxonomy(assets.sparkSession).drop("row_no").withColumnRenamed("category", "class_category").withColumnRenamed("subcategory", "class"))
    known = [r[1] for r in taxonomy.rows()]
    keyed = assets.withColumn("class", F.when(F.col("subcategory").isin(known), F.col("subcategory")).otherwise("other"))
    return keyed.join(dim, "class").withColumns({"subcategory": F.col("class"), "category": F.col("class_category")}).drop("class", "class_category")


def scored(assets: DataFrame, bands: Bands) -> DataFrame:
    """Every asset with band, distance, value, occupancy, urgency, priority and flags: one
    narrow pass, the taxonomy being broadcast."""
    at = distance_to_front(earliest_band(with_class(assets), bands), bands)
    urgent = value.urgency(F.col("minutes"), F.col("band_index"), len(bands))
    out = at.withColumns(value.valuation()).withColumns(value.occupancy()).withColumn("urgency", urgent)
    return out.withColumns({"priority": value.priority(F.col("urgency")), "inside_aoi": F.col("band_index").isNotNull(), "hazardous": F.col("subcategory").isin(taxonomy.HAZARDOUS), "response": F.col("subcategory").isin(taxonomy.RESPONSE), "critical": F.col("criticality") >= 90})


def in_perimeter(assets: DataFrame, bands: Bands, *, keep_band: bool = False) -> DataFrame:
    """The assets whose point is in any band or on its boundary; the envelope reaches the
    scan as four comparisons. ``keep_band`` leaves their band_index. For footprints see
    ``overlap.in_perimeter``."""
    box = geom.envelope([p for *_, polygons in bands for p in polygons])
    near = assets.filter(geom.in_envelope(F.col("lon"), F.col("lat"), box))
    hit = located(near, bands).filter(F.col("band_index").isNotNull() | F.col("touches"))
    return hit.drop("touches") if keep_band else hit.drop("touches", "band_index")


def rollup(scored_assets: DataFrame) -> DataFrame:
    """Sums by (band, category), by band, by category and over all, in one aggregation."""
    banded = scored_assets.filter("band_index is not null")
    grouped = banded.groupingSets([["band_index", "category"], ["band_index"], ["category"], []], "band_index", "category")
    return grouped.agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur"), F.sum(F.col("critical").cast("int")).alias("critical"), F.sum(F.col("hazardous").cast("int")).alias("hazardous"))


def band_summary(scored_assets: DataFrame, bands: Bands) -> DataFrame:
    """One row per band, also of those without an asset."""
    spark = scored_assets.sparkSession
    all_bands = spark.createDataFrame([(i, b[0], b[1]) for i, b in enumerate(bands)], "band_index int, band string, minutes double")
    sums = scored_assets.groupBy("band_index").agg(F.count("*").alias("assets"), F.sum("people").alias("people"), F.sum("total_eur").alias("value_eur"), F.sum(F.col("critical").cast("int")).alias("critical"))
    return all_bands.join(sums, "band_index", "left").select("band_index", "band", "minutes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("assets", "people", "value_eur", "critical")))


def summary(scored_assets: DataFrame) -> DataFrame:
    """The report's totals: counts over all assets, sums over those in a band, occupancy
    split into registry figures and class defaults."""
    when = lambda test, v: F.sum(F.when(test, v).otherwise(F.lit(0.0)))
    inside = F.col("inside_aoi")
    return scored_assets.agg(
        F.count("*").alias("asset_count"),
        when(inside, F.col("people")).alias("people"),
        when(inside & ~F.col("people_default"), F.col("people")).alias("people_registry"),
        when(inside & F.col("people_default"), F.col("people")).alias("people_default"),
        when(inside, F.col("total_eur")).alias("value_eur"),
        F.sum(F.col("critical").cast("int")).alias("critical"),
        F.sum(F.col("hazardous").cast("int")).alias("hazardous"),
        F.sum(F.col("response").cast("int")).alias("response"),
        F.coalesce(F.sum("livestock_units"), F.lit(0.0)).alias("livestock_units"),
    )


def resolve_layers(layers: list[str]) -> list[str] | None:
    """Categories of the wanted layers; a subcategory stands for its whole category, and
    nothing known, or ``all``, for everything (None)."""
    of = {r[1]: r[2] for r in taxonomy.rows()}
    wanted = {of.get(x, x) for x in layers if x in of or x in of.values()}
    return None if not wanted or {"all", "*"} & set(layers) else sorted(wanted)
