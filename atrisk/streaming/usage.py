"""Streams of requests and fetch outcomes kept as tables of current state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.operators.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one (``spark.checkpoint.dir``)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    path = f"{sf_dir}/events*.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def latest_state(updates: DataFrame, name: str) -> DataFrame:
    """Runs a stream in update mode over all that has arrived, and returns the rows that
    were last written for each key.

    Every micro-batch appends its changed rows with the batch number; a batch that is
    repeated after a failure overwrites its own folder, so that rows count once.
    """
    spark = updates.sparkSession
    out, keys = _folder(spark, name), [c for c in updates.columns if c.startswith("k_")]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", _folder(spark, f"{name}-state")).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), "batch").alias("r"))
    return last.select("r.*")


def daily_usage(stream: DataFrame, quota: int, late: str = "1 day") -> DataFrame:
    """Requests per key and day against a quota (0: unlimited); days are dropped from the
    state once the watermark has passed them."""
    day = F.window("ts", "1 day")
    used = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(day, F.col("user_id").alias("k_key")).agg(F.count("*").alias("used"))
    now = latest_state(used.select("k_key", F.to_date("window.start").alias("k_day"), "used"), "usage")
    return now.select(F.col("k_key").alias("key"), F.col("k_day").alias("day"), "used", ((F.lit(quota) > 0) & (F.col("used") > quota)).alias("over"))


def latest_outcomes(ledger: DataFrame) -> DataFrame:
    """The latest fetch of every tile: ``tile_key, fetched_at, event_id, status``. State is
    one row a tile."""
    fields = F.struct("fetched_at", "event_id", "status")
    now = latest_state(ledger.groupBy(F.col("tile_key").alias("k_tile")).agg(F.max_by(fields, fields).alias("r")), "tiles")
    return now.select(F.col("k_tile").alias("tile_key"), "r.*")


def ingested(stream: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """Lands a stream chunk by chunk; returns the table by key, where the row of the highest
    order stays, and the ledger ``chunk, rows`` of the chunks.

    A chunk's rows are written before its ledger line, each into a folder of its own number
    that a repeated chunk overwrites: a run that goes on after a failure changes nothing.
    """
    spark = stream.sparkSession
    rows, lines = _folder(spark, "chunks"), _folder(spark, "ledger")

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/chunk={number}")
        landed = spark.read.schema(batch.schema).parquet(f"{rows}/chunk={number}")
        landed.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{lines}/chunk={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", _folder(spark, "chunks-state")).foreachBatch(land).start().awaitTermination()
    landed = spark.read.option("basePath", rows).parquet(f"{rows}/chunk=*")
    columns = [c for c in landed.columns if c != "chunk"]
    table = landed.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key)), F.struct(*order)).alias("r")).select(key, "r.*")
    return table, spark.read.option("basePath", lines).parquet(f"{lines}/chunk=*")
