"""Stateful streams against their batch twins: shuffled micro-batches, a restart, timers."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from atrisk.operators import store
from atrisk.streaming import stateful

START = datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp"


def land(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_rates_equal_the_batch_over_shuffled_batches_and_a_restart(spark, tmp_path):
    folder, rng = f"file://{tmp_path}", random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), START + timedelta(seconds=rng.randrange(1800))) for i in range(400)]
    rows.sort(key=lambda r: r[2].timestamp() + rng.uniform(0, 600))  # up to ten minutes out of order
    odd = [(900, None, START), (901, 1, None)]
    end = [(999, 7, START + timedelta(days=1))]
    parts = [rows[:150] + odd, rows[150:300], rows[300:], end]
    for part in parts[:2]:
        stream = land(spark, folder, 0, part, EVENTS)
    early = stateful.rate_decisions(stream, 5, folder, late="30 minutes").count()
    assert early < 300
    for part in parts[2:]:
        stream = land(spark, folder, 0, part, EVENTS)
    got = stateful.rate_decisions(stream, 5, folder, late="30 minutes")
    want = store.rate_decisions(spark.createDataFrame(rows, EVENTS), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("event_id", "key", "allowed", "remaining", "retry_after").collect()))
    assert {r[0] for r in got.select("allowed").distinct().collect()} == {True, False}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB


def test_tiles_turn_stale_by_timers(spark, tmp_path):
    at = lambda **k: START + timedelta(**k)
    schema = "tile_key string, fetched_at timestamp, event_id long, status string"
    folder = f"file://{tmp_path}"
    first = [("a", at(hours=1), 2, "error"), ("a", at(hours=0), 1, "ok"), ("b", at(hours=0), 3, "error"), (None, at(hours=0), 4, "ok")]
    second = [("a", at(hours=1, minutes=10), 5, "ok"), ("b", at(hours=3), 6, "ok"), ("z", at(hours=60), 7, "ok")]
    land(spark, folder, 0, first, schema)
    stream = land(spark, folder, 1, second, schema)
    got = stateful.tile_changes(stream, folder, ttl_hours=24, late="2 hours")
    want = {
        ("a", at(hours=0), "fresh"), ("a", at(hours=1), "failed"), ("a", at(hours=1, minutes=10), "fresh"), ("a", at(hours=25, minutes=10), "stale"),
        ("b", at(hours=0), "failed"), ("b", at(minutes=30), "stale"), ("b", at(hours=3), "fresh"), ("b", at(hours=27), "stale"),
    }
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    ledger = spark.createDataFrame(first[:3] + second[:2], schema)
    states = {r["tile_key"]: r["state"] for r in store.tile_states(ledger, F.lit(at(hours=58)), ttl_hours=24).collect()}
    last = got.groupBy("tile_key").agg(F.max_by("state", "since").alias("state")).collect()
    assert {r["tile_key"]: r["state"] for r in last} == states


def test_registered_stream_equals_the_batch_up_to_the_watermark(spark):
    from atrisk.plans import registry
    from atrisk.sources import fixtures as fx

    events = fx.read(spark, "/root/testdata/sf0.001", "events")
    passed = events.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    settled = events.filter(F.col("ts") <= F.lit(passed)).select("event_id")
    want = store.rate_decisions(events, 3, 6 * 3600.0).join(settled, "event_id")
    got = registry.queries()["x2_rate_stream"](spark, "/root/testdata/sf0.001")
    columns = ["event_id", "key", "allowed", "remaining", "retry_after"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and got.count() > 900


def test_keys_share_calls_of_the_state_store(spark, tmp_path, monkeypatch):
    """Many keys in few groups are the keys' own results, and a batch steps once a group."""
    monkeypatch.setattr(stateful, "GROUPS", 3)
    rows = [(i, i % 50, START + timedelta(seconds=7 * (i * 37 % 400))) for i in range(400)]
    folder = f"file://{tmp_path}"
    steps = spark.sparkContext.accumulator(0)
    step = stateful._Rates.step

    def counted(self, group, frames, state):
        steps.add(1)
        yield from step(self, group, frames, state)

    monkeypatch.setattr(stateful._Rates, "step", counted)
    land(spark, folder, 0, rows, EVENTS)
    stream = land(spark, folder, 1, [(999, 77, START + timedelta(days=1))], EVENTS)
    got = stateful.rate_decisions(stream, 2, folder, seconds=600.0)
    want = store.rate_decisions(spark.createDataFrame(rows, EVENTS), 2, 600.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < steps.value <= 9


def test_tiles_of_one_group_turn_stale_each_in_its_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "GROUPS", 1)
    schema, folder = "tile_key string, fetched_at timestamp, event_id long, status string", f"file://{tmp_path}"
    at = [START + timedelta(hours=h) for h in range(6)]
    land(spark, folder, 0, [(f"t{i}", at[i], i, "ok") for i in range(6)], schema)
    stream = land(spark, folder, 1, [("z", START + timedelta(hours=28, minutes=30), 9, "ok")], schema)
    got = stateful.tile_changes(stream, folder, ttl_hours=24, late="1 hour")
    day = timedelta(hours=24)
    want = [(f"t{i}", t, "fresh") for i, t in enumerate(at)] + [(f"t{i}", t + day, "stale") for i, t in enumerate(at) if t + day < START + timedelta(hours=27, minutes=30)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


class _Held:
    """A group's state without Spark."""

    exists = hasTimedOut = False
    mark, get, wake = 0, None, None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.mark

    def update(self, new):
        self.get, self.exists = new, True

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.wake = at


def test_a_group_is_settled_whole_and_kept_as_two_blocks_of_bytes():
    """Values of a state are no objects of their own; tiles equal a loop over their rows."""
    rng, hour = random.Random(3), 3_600_000_000
    rows = [(f"t{rng.randrange(6)}", rng.randrange(1, 400) * hour // 4, i, rng.choice(["ok", "error", ""])) for i in range(300)]
    tiles, held, got = stateful._Tiles(5, 30), _Held(), []
    for mark, part in ((0, rows[:100]), (0, rows[100:]), (30, []), (60, []), (200, [])):
        held.mark = mark * 3_600_000
        frames = [pd.DataFrame(part, columns=["key", "at", "event_id", "status"])] if part else []
        got += [tuple(r) for f in tiles.step((0,), frames, held) for r in f.itertuples(index=False)]
        assert len(held.get) == 2 and all(isinstance(x, bytes) for x in held.get)
    want = []
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        ends = [at + (5 * hour if status == "ok" else hour // 2) for at, _, status in own]
        want += [(key, at, "fresh" if status == "ok" else "failed") for at, _, status in own]
        want += [(key, end, "stale") for end, after in zip(ends, [*(r[0] for r in own[1:]), 200 * hour], strict=True) if after > end]
    assert sorted(got) == sorted(want)
