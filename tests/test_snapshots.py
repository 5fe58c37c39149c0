"""Partitioned tables: what a refresh rewrites and leaves, exports and restores."""

import pathlib

from pyspark.sql import functions as F

from atrisk.operators import snapshots

SCHEMA = "tile_key string, id long, note string"


def block():
    return F.substring("tile_key", 1, 1)


def files(path):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in pathlib.Path(path).glob("*/*.parquet")}


def test_refresh_rewrites_touched_blocks_only(spark, tmp_path):
    path, local = f"file://{tmp_path}/t", f"{tmp_path}/t"
    snapshots.create(spark.createDataFrame([("a1", 1, "x"), ("a2", 2, "x"), ("b1", 3, "x"), ("c1", 4, "x")], SCHEMA), path, block())
    before = files(local)
    batch = spark.createDataFrame([("a1", 10, None), ("a1", 11, "new"), ("a2", 12, "not refreshed"), ("d1", 13, "new block"), (None, 14, "no tile")], SCHEMA)
    refreshed = spark.createDataFrame([("a1",), ("a1",), ("c1",), ("d1",), (None,)], "tile_key string")
    want = {("a1", 10, None), ("a1", 11, "new"), ("a2", 2, "x"), ("b1", 3, "x"), ("d1", 13, "new block")}
    for _ in range(2):
        snapshots.refresh(spark, path, batch, refreshed, block())
        got = [tuple(r) for r in snapshots.current(spark, path).select("tile_key", "id", "note").collect()]
        assert set(got) == want and len(got) == len(want)
    after = files(local)
    assert after["block=b"] == before["block=b"] and after["block=a"] != before["block=a"] and set(after) == {"block=a", "block=b", "block=c", "block=d"}
    snapshots.refresh(spark, path, batch, refreshed.limit(0), block())
    assert files(local) == after
    plan = snapshots.current(spark, path).filter("block = 'b'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan


def test_export_and_restore(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    tables = {"one": spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"), "none": spark.createDataFrame([], "id long, v string")}
    assert {tuple(r) for r in snapshots.export(tables, folder).collect()} == {("one", 2), ("none", 0)}
    own = spark.createDataFrame([(2, "old"), (3, "own")], "id long, v string")
    out, wrong = snapshots.restore(spark, folder, {"one": (own, "id"), "none": (own, "id"), "absent": (own, "id")})
    assert {tuple(r) for r in out["one"].collect()} == {(1, "a"), (2, None), (3, "own")}
    assert {tuple(r) for r in out["none"].collect()} == {tuple(r) for r in out["absent"].collect()} == {(2, "old"), (3, "own")}
    assert wrong.count() == 0
    tables["one"].limit(1).write.mode("overwrite").parquet(f"{folder}/one")
    _, wrong = snapshots.restore(spark, folder, {"one": (own, "id")})
    assert [tuple(r) for r in wrong.collect()] == [("one", 2, 1)]
