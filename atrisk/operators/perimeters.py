"""Many perimeters as a table: which assets each holds, and re-scoring as perimeters change.

A perimeter has bands, a band has parts, a part is ring 0 with its holes: rows of
``perimeter_id, band_index, part, ring, points`` (structs x, y). Nothing of a perimeter
enters the plan, so there may be as many as there are assets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.operators.shared import shared_dir

#: Degrees of the cells over which perimeters meet assets, and the parts of a cell's perimeters.
CELL, PARTS = 0.05, 8


def edge_table(perimeters: DataFrame) -> DataFrame:
    """``perimeter_id, band_index, part, ring, x1, y1, x2, y2``: each vertex with the next and
    the last with the first; edges without length are left out, so closed rings do as well."""
    n, at = F.size("points"), lambda i: F.get(F.col("points"), i % F.size("points"))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i)["x"].alias("x1"), at(i)["y"].alias("y1"), at(i + 1)["x"].alias("x2"), at(i + 1)["y"].alias("y2")))
    out = perimeters.filter(n > 2).select("perimeter_id", "band_index", "part", "ring", F.inline(pairs))
    return out.filter("x1 <> x2 or y1 <> y2")


def _range(low: Column, high: Column, step: float) -> Column:
    return F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))


def _bands_of(x: np.ndarray, y: np.ndarray, edges: dict[str, np.ndarray]) -> np.ndarray:
    """The first band of each point by the even-odd rule, -1 without; the edges of one
    perimeter come in order of band, part and ring."""
    x1, y1, x2, y2 = (edges[c][:, None] for c in ("x1", "y1", "x2", "y2"))
    crossed = ((y2 > y) != (y1 > y)) & (x < (y - y2) * (x1 - x2) / (y1 - y2) + x2)
    band, part, ring = edges["band_index"], edges["part"], edges["ring"]
    starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1]) | (ring[1:] != ring[:-1])])
    odd = np.logical_xor.reduceat(crossed, starts, axis=0)
    band, part, ring = band[starts], part[starts], ring[starts]
    first = np.full(len(x), -1, dtype=np.int64)
    at = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1]), True])
    for i, j in zip(at[:-1][::-1], at[1:][::-1], strict=True):  # the last bands first, so that the first one stays
        if ring[i] == 0:  # inside a part: within its outer ring (0) and no hole
            inside = odd[i] & ~odd[i + 1 : j].any(axis=0) if j > i + 1 else odd[i]
            first[inside] = band[i]
    return first


def _held(points: pa.Table, edges: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Table]]:
    """Of one cell: the first row of each perimeter's edges, its points, their bands, and the edges in order."""
    if not (points.num_rows and edges.num_rows):
        return
    edges = edges.sort_by([(c, "ascending") for c in ("perimeter_id", "band_index", "part", "ring")])
    e = {c: edges[c].to_numpy() for c in edges.column_names if c != "perimeter_id"}
    ids = edges["perimeter_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    x, y = points["lon"].to_numpy(), points["lat"].to_numpy()
    rows = np.argsort(y, kind="stable")
    x, y = x[rows], y[rows]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    low, high = np.searchsorted(y, e["y0"][starts], "left"), np.searchsorted(y, e["ym"][starts], "right")
    for i, j, a, b in zip(starts, np.r_[starts[1:], len(ids)], low, high, strict=True):
        near = a + np.flatnonzero((x[a:b] >= e["x0"][i]) & (x[a:b] <= e["xm"][i]))
        if len(near):
            bands = _bands_of(x[near], y[near], {c: e[c][i:j] for c in ("band_index", "part", "ring", "x1", "y1", "x2", "y2")})
            hit = bands >= 0
            if hit.any():
                yield i, rows[near[hit]], bands[hit], edges


def _meeting(assets: DataFrame, perimeters: DataFrame, columns: list[str]):
    """Assets and the edges that they may cross, by cell and part of its perimeters: numbers of
    both grow with the rows. Edges lie in the cells that their perimeter's envelope spans as far
    as their own right end. Assets without coordinates and rings of fewer than three points are left out."""
    n = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edge_table(perimeters)
    box = edges.filter("ring = 0").groupBy("perimeter_id").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("xm"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("ym"))
    right = F.least("xm", F.greatest("x1", "x2") + 1e-6)
    level = edges.filter("y1 <> y2").join(box.hint("merge"), "perimeter_id").filter(right >= F.col("x0")).withColumn("slot", F.pmod(F.xxhash64("perimeter_id"), F.lit(PARTS)))
    level = level.select("*", _range(F.col("x0"), right, CELL).alias("cx")).select("*", _range(F.least("y1", "y2"), F.greatest("y1", "y2"), CELL).alias("cy"))
    points = assets.select(*columns, "lon", "lat", F.floor(F.col("lon") / CELL).alias("cx"), F.floor(F.col("lat") / CELL).alias("cy")).dropna(subset=["cx", "cy"])
    points = points.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("slot"))
    key = ["cx", "cy", "slot"]
    grouped = [df.repartition(n, *key).groupBy(*key) for df in (points, level)]
    return grouped[0].cogroup(grouped[1])


def _kinds(perimeters: DataFrame) -> str:
    return f"perimeter_id {perimeters.schema['perimeter_id'].dataType.simpleString()}"


def first_bands(assets: DataFrame, perimeters: DataFrame) -> DataFrame:
    """``perimeter_id, id, band_index``: every asset (``id, lon, lat``) in a perimeter, with its
    first band that holds the point by the even-odd rule."""
    schema = f"{_kinds(perimeters)}, id {assets.schema['id'].dataType.simpleString()}, band_index int"

    def pairs(points: pa.Table, edges: pa.Table) -> pa.Table:
        none = pa.table({"perimeter_id": edges["perimeter_id"].slice(0, 0), "id": points["id"].slice(0, 0), "band_index": pa.array([], pa.int32())})
        found = [pa.table({"perimeter_id": e["perimeter_id"].take(pa.array(np.full(len(rows), i))), "id": points["id"].take(pa.array(rows)), "band_index": pa.array(bands, pa.int32())}) for i, rows, bands, e in _held(points, edges)]
        return pa.concat_tables([none, *found])

    return _meeting(assets, perimeters, ["id"]).applyInArrow(pairs, schema)


def exposed(assets: DataFrame, perimeters: DataFrame) -> DataFrame:
    """``perimeter_id, band_index, assets, people, value_eur`` of valued assets. Each cell gives
    a perimeter's sums, so that pairs of perimeters and assets never leave it."""
    sums = {"people": "people", "total_eur": "value_eur"}
    schema = f"{_kinds(perimeters)}, band_index int, assets long, people double, value_eur double"

    def cell(points: pa.Table, edges: pa.Table) -> pa.Table:
        given = {c: (points[c].fill_null(0.0).to_numpy(), points[c].is_valid().to_numpy()) for c in sums}
        ids, first, out = edges["perimeter_id"], [], {"band_index": [], "assets": [], "people": [], "value_eur": []}
        for i, rows, bands, ordered in _held(points, edges):
            for band in np.unique(bands):
                of = rows[bands == band]
                first.append(i)
                ids = ordered["perimeter_id"]
                out["band_index"].append(int(band))
                out["assets"].append(len(of))
                for c, name in sums.items():
                    out[name].append(float(given[c][0][of].sum()) if given[c][1][of].any() else None)
        kinds = {"band_index": pa.int32(), "assets": pa.int64(), "people": pa.float64(), "value_eur": pa.float64()}
        return pa.table({"perimeter_id": ids.take(pa.array(first, pa.int64())), **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    valued = assets.select("lon", "lat", *(F.col(c).cast("double").alias(c) for c in sums))
    cells = _meeting(valued, perimeters, list(sums)).applyInArrow(cell, schema)
    return cells.groupBy("perimeter_id", "band_index").agg(*(F.sum(c).alias(c) for c in ("assets", "people", "value_eur")))


def evolving(stream: DataFrame, assets: DataFrame) -> DataFrame:
    """Scores perimeters as their versions arrive (rows with ``version`` beside a perimeter's
    columns) and returns :func:`exposed` of each perimeter's latest version.

    Tables of versions are small as files and large in memory: their joins merge, as none may
    be broadcast. A micro-batch scores only the perimeters it brings, against all assets, each in the latest
    of its versions; it writes into a folder of its own number, so that a batch that is repeated
    after a failure counts once. Versions may arrive late or out of order, but whole: one
    version's rows in one batch.
    """
    spark = assets.sparkSession
    out = f"{shared_dir(spark)}/perimeters-{uuid.uuid4().hex}"

    def score(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("perimeter_id").agg(F.max("version").alias("version"))
        newest.write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
        kept = spark.read.parquet(f"{out}/versions/batch={number}")
        exposed(assets, batch.join(kept.hint("merge"), ["perimeter_id", "version"]).drop("version")).join(kept.hint("merge"), "perimeter_id").write.mode("overwrite").parquet(f"{out}/scores/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(score).start().awaitTermination()
    versions = spark.read.option("basePath", f"{out}/versions").parquet(f"{out}/versions/batch=*")
    last = versions.groupBy("perimeter_id").agg(F.max(F.struct("version", "batch")).alias("v")).select("perimeter_id", "v.*")
    scores = spark.read.option("basePath", f"{out}/scores").parquet(f"{out}/scores/batch=*")
    return scores.join(last.hint("merge"), ["perimeter_id", "version", "batch"]).drop("version", "batch")
