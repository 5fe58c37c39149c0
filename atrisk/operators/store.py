"""Keyed tables: upsert, latest state, freshness, ledgers and their statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in_batch(batch: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows that share a key the one that comes first."""
    w = Window.partitionBy(key).orderBy(position)
    return batch.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(base: DataFrame, batch: DataFrame, key: str, position: str, needs: Sequence[str] = ()) -> DataFrame:
    """The batch's first row of a key replaces the base's; the rest of the base stays. Rows of the
    batch that lack any of the columns ``needs`` (as an asset its place) are dropped before."""
    usable = batch.dropna(subset=list(needs)) if needs else batch
    fresh = first_in_batch(usable, key, position).drop(position)
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def latest(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The latest row of each key, by partial aggregation rather than a sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(at, *columns), F.struct(at, *columns)).alias("r")).select(key, "r.*")


def tile_states(ledger: DataFrame, as_of: Column, *, ttl_hours: float = 336, backoff_minutes: float = 30) -> DataFrame:
    """fresh: ok within the TTL; failed: not ok within the backoff; else stale."""
    return state_of(latest(ledger, "tile_key", "fetched_at", "event_id", "status"), as_of, ttl_hours=ttl_hours, backoff_minutes=backoff_minutes)


def state_of(now: DataFrame, as_of: Column, *, ttl_hours: float = 336, backoff_minutes: float = 30) -> DataFrame:
    """The state of tiles of which ``now`` holds the latest outcome."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 1e6
    state = F.when((F.col("status") == "ok") & (age <= ttl_hours * 3600), "fresh").when((F.col("status") != "ok") & (age <= backoff_minutes * 60), "failed").otherwise("stale")
    return now.select("tile_key", "fetched_at", "status", state.alias("state"))


def daily_usage(events: DataFrame, quota: int) -> DataFrame:
    """Requests per key and day with the day's use against a quota (0: unlimited)."""
    used = events.groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("over", (F.lit(quota) > 0) & (F.col("used") > quota))


def delete_where(rows: DataFrame, test: Column) -> DataFrame:
    """What stays after a delete: rows for which the test is false or null."""
    return rows.filter(~F.coalesce(test, F.lit(False)))


def replace_tiles(base: DataFrame, batch: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Rows of refreshed tiles come from the batch, all others stay; rows of the batch whose
    tile was not refreshed are left out."""
    return base.join(refreshed, "tile_key", "left_anti").unionByName(batch.join(refreshed, "tile_key", "left_semi"))


def trailing_requests(events: DataFrame, seconds: int) -> DataFrame:
    """Per request the key's requests in the seconds up to and with it."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").alias("key"), F.count("*").over(w).alias("requests"))


def block_plan(tiles: DataFrame, fresh: DataFrame, side: int) -> DataFrame:
    """Blocks of side x side tiles that hold one to fetch, each tile in exactly one."""
    marked = tiles.join(fresh.select("tile_key", F.lit(1).alias("fresh")), "tile_key", "left")
    index = lambda c: F.floor(F.col(c) / side).alias(f"b{c}")
    blocks = marked.groupBy(index("ix"), index("iy")).agg(F.count("*").alias("tiles"), F.sum(F.when(F.col("fresh").isNull(), 1).otherwise(0)).alias("to_fetch"))
    return blocks.filter("to_fetch > 0")


def decision(hits: deque, now: int, limit: int, seconds: float) -> tuple[bool, int, int]:
    """``allowed, remaining, retry_after`` of a request at ``now`` (microseconds) after a key's
    counted ``hits``, to which it is added if it is allowed and there is a limit."""
    while hits and now - hits[0] > seconds * 1e6:
        hits.popleft()
    if limit <= 0:
        return True, -1, 0
    if len(hits) >= limit:
        return False, 0, max(1, int(seconds + 1 - (now - hits[0]) / 1e6))
    hits.append(now)
    return True, limit - len(hits), 0


def rate_decisions(events: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """``event_id, key, allowed, remaining, retry_after`` of every request under a sliding
    limit (0: unlimited), where a request that is denied does not count for later ones.

    That rule depends on all earlier decisions of the key, so each key is read in order of
    time, then event; what a task holds is one key's last ``limit`` hits, however many
    requests the key has. Requests without a time count as the earliest.
    """
    schema = "event_id long, key long, allowed boolean, remaining long, retry_after long"
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))).alias("at")
    ordered = events.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("key"), at).repartition("key").sortWithinPartitions("key", "at", "event_id")

    def decide(batches):
        at_key, hits = object(), deque()
        for batch in batches:
            out = []
            keys = batch.column("key").to_pylist()
            for key, now in zip(keys, batch.column("at").to_pylist(), strict=True):
                if key != at_key:
                    at_key, hits = key, deque()
                out.append(decision(hits, now, limit, seconds))
            allowed, remaining, retry = zip(*out, strict=True) if out else ((), (), ())
            columns = [batch.column("event_id"), batch.column("key"), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(retry, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", "key", "allowed", "remaining", "retry_after"])

    return ordered.mapInArrow(decide, schema)
