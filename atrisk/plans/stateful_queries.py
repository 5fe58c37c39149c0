"""Registered queries of streams with a state and timers per key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atrisk.operators.shared import shared_dir
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx
from atrisk.streaming import stateful, usage

_LATE = "date_trunc('milliseconds', (select max(fetched_at) from l)) - interval 1 hour"


@query("x1_tile_changes", f"""with l as {fx.LEDGER_SQL}, w as (select {_LATE} as passed),
s as (select *, fetched_at + case when status = 'ok' then interval 24 hour else interval 30 minute end as until, lead(fetched_at) over (partition by tile_key order by fetched_at, event_id) as after from l, w where fetched_at <= passed)
select tile_key, epoch_us(fetched_at::timestamp) as since, case when status = 'ok' then 'fresh' else 'failed' end as state from s
union all select tile_key, epoch_us(until::timestamp), 'stale' from s where until < coalesce(after, passed)""")
def x1_changes(spark, sf_dir):
    """Changes up to an hour before the latest fetch, which is what the watermark has passed."""
    folder = f"{shared_dir(spark)}/tile-changes-{uuid.uuid4().hex}"
    changes = stateful.tile_changes(fx.ledger_rows(usage.events(spark, sf_dir)), folder, ttl_hours=24)
    return changes.select("tile_key", F.unix_micros("since").alias("since"), "state")


# Decisions depend on earlier ones; tests hold the stream against its batch twin.
@query("x2_rate_stream")
def x2_stream(spark, sf_dir):
    return stateful.rate_decisions(usage.events(spark, sf_dir), 3, f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}", seconds=6 * 3600.0)
