"""Tables kept as partitioned Parquet: refreshes that rewrite only the partitions they touch,
exports with a manifest of counts, and restores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.operators.shared import written
from atrisk.operators.store import upsert


def create(rows: DataFrame, path: str, block: Column) -> None:
    """Writes ``rows`` below ``path``, a folder per value of ``block``; rows of one block come
    together so that it gets few files, and large ones are dealt to several by size."""
    placed = rows.withColumn("block", block)
    placed.hint("rebalance", "block").write.partitionBy("block").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows with their ``block``; a filter on it reads only those folders."""
    return spark.read.parquet(path).filter("tile_key is not null")


def refresh(spark: SparkSession, path: str, batch: DataFrame, refreshed: DataFrame, block: Column) -> None:
    """Replaces the rows of refreshed tiles (``tile_key``) by the batch's; rows of the batch whose
    tile was not refreshed are left out, all other tiles stay.

    Only blocks that hold a refreshed tile are read and rewritten, by dynamic partition
    overwrite: other blocks keep their files. The new rows are written apart first, so that a
    failure leaves the table as it was before the last step, which may be repeated. A block
    that becomes empty keeps one row without a tile, which ``current`` leaves out, as the
    overwrite does not touch a folder for which it is given no rows. Repeating it changes nothing.
    """
    tiles = written(refreshed.select("tile_key").filter("tile_key is not null").distinct().withColumn("block", block), "refreshed")
    blocks = tiles.select("block").distinct()
    # no more names than the table has folders, which the driver lists anyway: a partition filter
    touched = [r["block"] for r in blocks.collect()]
    if not touched:
        return
    kept = current(spark, path).filter(F.col("block").isin(touched)).join(tiles.select("tile_key"), "tile_key", "left_anti")
    names = [c for c in kept.columns if c != "block"]
    fresh = batch.join(tiles, "tile_key").select(*names, "block")
    rows = kept.select(*names, "block").unionByName(fresh)
    empty = blocks.join(rows.select("block").distinct(), "block", "left_anti")
    marks = empty.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names), "block")
    ready = written(rows.unionByName(marks), "refresh")
    ready.hint("rebalance", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` of every table, empty ones with 0, in one aggregation over all."""
    spark = next(iter(tables.values())).sparkSession
    each = reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("table"), F.lit(1).cast("long").alias("n")) for n, t in tables.items()))
    names = spark.createDataFrame([(n, 0) for n in tables], "table string, n long")
    return each.groupBy("table").agg(F.sum("n").alias("n")).unionByName(names).groupBy("table").agg(F.sum("n").alias("rows"))


def export(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes every table and then the manifest, which tells of a whole export; counts are those
    of what was written. Returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    stored = {n: spark.read.schema(t.schema).parquet(f"{folder}/{n}") for n, t in tables.items()}
    counts(stored).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema("table string, rows long").json(f"{folder}/manifest")


def restore(spark: SparkSession, folder: str, into: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (name: table and key) with an export's rows in place of their own of equal
    key, and ``table, expected, found`` where the export's rows are not as many as its manifest
    says. Restoring twice changes nothing. Tables that the export lacks stay as they are."""
    manifest = spark.read.schema("table string, rows long").json(f"{folder}/manifest")
    known = {r["table"] for r in manifest.filter(F.col("table").isin(list(into))).collect()}  # names of tables, as many as asked for
    stored = {n: spark.read.schema(into[n][0].schema).parquet(f"{folder}/{n}") for n in into if n in known}
    out = {n: upsert(t, stored[n].withColumn("__at", F.lit(0)), key, "__at") if n in stored else t for n, (t, key) in into.items()}
    wanted = manifest.select("table", F.col("rows").alias("expected"))
    if not stored:
        return out, wanted.withColumn("found", F.lit(0).cast("long")).limit(0)
    found = counts(stored).withColumnRenamed("rows", "found")
    return out, wanted.join(found, "table").filter("expected <> found").select("table", "expected", "found")
