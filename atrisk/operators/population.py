"""Population cells against time-banded perimeters, by a grid of sample points in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrisk.operators.exposure import Bands, earliest_band


def band_shares(cells: DataFrame, bands: Bands, samples: int = 10) -> DataFrame:
    """``cell_id, population, band_index, share``: of each cell the share of its n x n
    mid-points whose earliest band is the given one (null: in none).

    Shares of one cell are exclusive and add up to one. Cells have ``x0, y0, size``; the
    samples stay within their row, so nothing but the counts is shuffled.
    """
    steps = F.sequence(F.lit(0), F.lit(samples - 1))
    points = cells.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    at = lambda corner, i: F.col(corner) + (F.col(i) + 0.5) / F.lit(float(samples)) * F.col("size")
    placed = earliest_band(points.select("cell_id", "population", at("x0", "i").alias("lon"), at("y0", "j").alias("lat")), bands)
    return placed.groupBy("cell_id", "population", "band_index").agg((F.count("*") / F.lit(float(samples * samples))).alias("share"))


def by_band(shares: DataFrame) -> DataFrame:
    """People per band on ground that no earlier band covers."""
    inside = shares.filter("band_index is not null")
    return inside.groupBy("band_index").agg(F.sum(F.col("population") * F.col("share")).alias("people"), F.count("*").alias("cells"))


def total(shares: DataFrame) -> DataFrame:
    """People in any band, the cells touched, and the densest of them (people per cell)."""
    inside = shares.filter("band_index is not null").groupBy("cell_id", "population").agg(F.least(F.sum("share"), F.lit(1.0)).alias("share"))
    return inside.agg(F.sum(F.col("population") * F.col("share")).alias("people"), F.count("*").alias("cells"), F.max("population").alias("peak"))
