"""Streams with a state and times to wake per key: sliding rate limits and the states of tiles.

Micro-batches may bring a key's rows in any order within the lateness allowed, so both wait for
the watermark and then read a key's rows in order of time: results don't depend on how the rows
were dealt to batches. Rows later than that are dropped by the watermark."""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from atrisk.operators.store import decision

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    """States of many keys are kept by RocksDB, outside the heap; a stream takes the setting as it
    starts, after which the session has its own again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Into how many groups keys are dealt by their hash. A checkpoint holds for this number only.
GROUPS = 1024


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


class _InOrder:
    """Keeps rows until the watermark has passed them, then hands them on by key and in order.

    Calls between Python and the state store cost some milliseconds, so keys share them: a state
    is one row for a group of keys. Its waiting rows and what its keys keep are a table of Arrow
    each, packed as bytes, so that storing a value costs no object of its own."""

    key = pa.int64()
    #: What a waiting row holds beside its key, its time in microseconds first.
    waits = {"at": pa.int64(), "event_id": pa.int64()}
    #: What a key keeps beside.
    keeps: dict = {}
    #: The columns of results.
    gives: dict = {}

    def settle(self, ready: pa.Table, kept: pa.Table, passed: int) -> tuple[dict, pa.Table, int | None]:
        """Columns of results of rows in order of key and time, what keys keep, and when the first
        of these wakes without any row."""
        raise NotImplementedError

    def step(self, group, frames, state) -> Iterator[pd.DataFrame]:
        schema = pa.schema({"key": self.key, **self.waits})
        if state.exists:
            waiting, kept = (pa.ipc.open_stream(bytes(x)).read_all() for x in state.get)
        else:
            waiting, kept = schema.empty_table(), pa.schema({"key": self.key, **self.keeps}).empty_table()
        if not state.hasTimedOut:
            waiting = pa.concat_tables([waiting, *(pa.Table.from_pandas(f[schema.names], schema, preserve_index=False) for f in frames)])
        mark, made, wakes = state.getCurrentWatermarkMs(), {}, []
        if mark > 0:
            passed = pc.less_equal(waiting["at"], mark * 1000)
            ready, waiting = waiting.filter(passed), waiting.filter(pc.invert(passed))
            made, kept, wake = self.settle(ready.sort_by([(c, "ascending") for c in schema.names]).combine_chunks(), kept.combine_chunks(), mark * 1000)
            wakes += [] if wake is None else [wake]
        state.update((_packed(waiting), _packed(kept)))
        if len(waiting):
            wakes.append(pc.min(waiting["at"]).as_py())
        if wakes:  # a timer is due once the watermark is beyond it
            state.setTimeoutTimestamp(max((min(wakes) - 1) // 1000, mark, 1))
        if made and len(made[next(iter(self.gives))]):
            yield pd.DataFrame({c: made[c] for c in self.gives})

    def over(self, rows: DataFrame) -> DataFrame:
        """Results over rows of ``key``, what waits, and ``time``."""
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
        return dealt.groupBy("group").applyInPandasWithState(self.step, self.schema(), "waiting binary, kept binary", "Append", GroupStateTimeout.EventTimeTimeout)

    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, kind in self.gives.items())


def _bounds(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each key's rows begin and end, of sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)))
    return first, np.append(first[1:], len(keys))


class _Rates(_InOrder):
    keeps = {"hits": pa.list_(pa.int64())}
    gives = {"event_id": "long", "key": "long", "allowed": "boolean", "remaining": "long", "retry_after": "long"}

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds = limit, seconds

    def settle(self, ready, kept, passed):
        hits = dict(zip(kept["key"].to_pylist(), kept["hits"].to_pylist(), strict=True))
        keys, at = ready["key"].combine_chunks(), ready["at"].to_pylist()
        first, end = _bounds(keys)
        made = []
        for key, lo, hi in zip(keys.take(pa.array(first)).to_pylist(), first.tolist(), end.tolist(), strict=True):
            held = deque(hits.get(key, ()))
            made += [decision(held, x, self.limit, self.seconds) for x in at[lo:hi]]
            hits[key] = list(held)
        columns = zip(*made, strict=True) if made else ((), (), ())
        out = {"event_id": ready["event_id"].to_numpy(), "key": ready["key"].to_numpy(), **dict(zip(("allowed", "remaining", "retry_after"), columns, strict=True))}
        return out, pa.table({"key": pa.array(hits.keys(), self.key), "hits": pa.array(hits.values(), self.keeps["hits"])}), None


class _Tiles(_InOrder):
    key = pa.string()
    waits = {**_InOrder.waits, "status": pa.string()}
    #: When a tile's last outcome runs out; a stale tile keeps nothing.
    keeps = {"until": pa.int64()}
    gives = {"tile_key": "string", "since": "long", "state": "string"}

    def __init__(self, ttl_hours: float, backoff_minutes: float) -> None:
        self.fresh, self.failed = int(ttl_hours * 3.6e9), int(backoff_minutes * 6e7)

    def settle(self, ready, kept, passed):
        keys, at, ok = ready["key"].combine_chunks(), ready["at"].to_numpy(), pc.equal(ready["status"], "ok").to_numpy()
        until = at + np.where(ok, self.fresh, self.failed)
        first, end = _bounds(keys)
        own, before = keys.take(pa.array(first)), kept["key"].combine_chunks()
        # until when the outcome before each row held, if there is one
        place = pc.index_in(own, value_set=before)
        held, known = np.roll(until, 1), np.ones(len(at), bool)
        known[first] = place.is_valid().to_numpy(zero_copy_only=False)
        old = kept["until"].to_numpy()
        held[first[known[first]]] = old[place.drop_null().to_numpy()]
        stale = known & (at > held)
        # what each key's last outcome leaves
        idle = pc.invert(pc.is_in(before, value_set=own))
        last = end - 1
        names, ends = pa.concat_arrays([own, before.filter(idle)]), np.concatenate([until[last], old[idle.to_numpy(zero_copy_only=False)]])
        over = ends < passed
        made = {
            "tile_key": pa.concat_arrays([keys, keys.filter(pa.array(stale)), names.filter(pa.array(over))]).to_numpy(zero_copy_only=False),
            "since": np.concatenate([at, held[stale], ends[over]]),
            "state": np.concatenate([np.where(ok, "fresh", "failed").astype(object), np.full(stale.sum() + over.sum(), "stale", object)]),
        }
        live = ends[~over]
        return made, pa.table({"key": names.filter(pa.array(~over)), "until": pa.array(live, pa.int64())}), int(live.min()) + 1 if len(live) else None


def _written(made: DataFrame, out: str, checkpoint: str) -> None:
    """Runs the stream over what has arrived; a batch overwrites its own folder, so a run
    that goes on after a failure gives every row once."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _state_store(made.sparkSession):
        run = made.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    run.awaitTermination()


def _timed(stream: DataFrame, column: str, late: str) -> DataFrame:
    return stream.withColumn("time", F.col(column).cast("timestamp")).filter("time is not null").withWatermark("time", late).withColumn("at", F.unix_micros("time"))


def rate_decisions(stream: DataFrame, limit: int, folder: str, *, seconds: float = 60.0, late: str = "1 hour") -> DataFrame:
    """``store.rate_decisions`` over a stream of ``event_id, user_id, ts``: state is a key's last
    hits, no more than ``limit``, and its requests within the lateness, which are decided once
    the watermark has passed them. Requests without a time or key are left out. ``folder`` keeps results
    and checkpoint; a later call goes on from there and returns all that was decided."""
    rows = _timed(stream, "ts", late).filter("user_id is not null").select("time", "at", F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("key"))
    rates = _Rates(limit, seconds)
    _written(rates.over(rows), f"{folder}/decisions", f"{folder}/checkpoint")
    return stream.sparkSession.read.schema(rates.schema()).parquet(f"{folder}/decisions/batch=*")


def tile_changes(stream: DataFrame, folder: str, *, ttl_hours: float = 336, backoff_minutes: float = 30, late: str = "1 hour") -> DataFrame:
    """``tile_key, since, state`` whenever a tile's state changes or is renewed, from a stream of
    fetch outcomes (``tile_key, fetched_at, event_id, status``): fresh after a fetch that went
    well, failed after another, and stale, by a timer, when the time to live or the backoff has
    run out. ``folder`` as in ``rate_decisions``."""
    rows = _timed(stream, "fetched_at", late).filter("tile_key is not null").select("time", "at", F.col("event_id").cast("long").alias("event_id"), F.col("tile_key").alias("key"), F.coalesce("status", F.lit("")).alias("status"))
    tiles = _Tiles(ttl_hours, backoff_minutes)
    _written(tiles.over(rows), f"{folder}/changes", f"{folder}/checkpoint")
    found = stream.sparkSession.read.schema(tiles.schema()).parquet(f"{folder}/changes/batch=*")
    return found.withColumn("since", F.timestamp_micros("since"))
