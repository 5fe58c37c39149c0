"""Registered queries of partitioned tables, exports and restores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atrisk.operators import snapshots
from atrisk.operators.shared import shared_dir
from atrisk.plans.registry import query
from atrisk.sources import fixtures as fx


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("u3_partition_refresh", """with b as (select 't' || o_custkey % 97 as tile_key, o_custkey % 97 as t, o_orderkey as id, o_totalprice as price from orders)
select tile_key, id, price from b where t % 3 > 0 and t not between 40 and 49
union all select tile_key, id, 2 * price from b where t % 3 = 0 and t % 9 > 0 and t not between 40 and 49 and id % 2 = 0""")
def u3_partitions(spark, sf_dir):
    # tiles of a third and a whole block are refreshed; those of a ninth and of the block are empty now
    t = F.col("o_custkey") % 97
    base = fx.read(spark, sf_dir, "orders").select(F.concat(F.lit("t"), t.cast("string")).alias("tile_key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    block = F.floor(F.substring("tile_key", 2, 9).cast("int") / 10)
    number = F.substring("tile_key", 2, 9).cast("int")
    path = _folder(spark, "assets")
    snapshots.create(base, path, block)
    batch = base.filter((number % 9 > 0) & ~number.between(40, 49) & (F.col("id") % 2 == 0)).withColumn("price", F.col("price") * 2)
    refreshed = base.select("tile_key").filter((number % 3 == 0) | number.between(40, 49))
    for _ in range(2):  # the second time changes nothing
        snapshots.refresh(spark, path, batch, refreshed, block)
    return snapshots.current(spark, path).select("tile_key", "id", "price")


def _tables(spark, sf_dir):
    return {
        "assets": fx.assets(spark, sf_dir).select(F.col("id"), F.col("name").alias("value")),
        "cells": fx.pop_grid(spark, sf_dir).select(F.col("cell_id").alias("id"), F.col("population").cast("long").cast("string").alias("value")),
        "runs": fx.source_runs(spark, sf_dir).select(F.col("run_id").cast("string").alias("id"), F.col("status").alias("value")),
    }


@query("r10_export_manifest", f"select 'assets' as table, count(*) as rows from {fx.ASSETS_SQL} union all select 'cells', count(*) from {fx.GRID_SQL} union all select 'runs', count(*) from {fx.RUNS_SQL}")
def r10_manifest(spark, sf_dir):
    return snapshots.export(_tables(spark, sf_dir), _folder(spark, "export"))


@query("r11_restore_tables", f"select 'assets' as table, id, name as value from {fx.ASSETS_SQL} union all select 'cells', cell_id, population::bigint::varchar from {fx.GRID_SQL} union all select 'runs', run_id::varchar, status from {fx.RUNS_SQL}")
def r11_tables(spark, sf_dir):
    tables, folder = _tables(spark, sf_dir), _folder(spark, "export")
    snapshots.export(tables, folder)
    half = F.crc32("id") % 2 == 0
    into = {n: (t.filter(half).withColumn("value", F.lit("old")), "id") for n, t in tables.items()}
    restored, _ = snapshots.restore(spark, folder, into)
    parts = [t.select(F.lit(n).alias("table"), "id", "value") for n, t in restored.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
